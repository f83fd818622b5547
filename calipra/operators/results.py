"""Measurements after reading: filters, back-filled units, deduplication, order, and status of lines and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calipra.functions.text import complete_unit, is_number, is_telemetry, name_key, normalize_name, parser_unit, parser_value


def clean_measurements(df: DataFrame) -> DataFrame:
    """STR-17 to 19, FLT-2 and 3: rows (name, value, unit, ...) with normalised names, values and units, less telemetry and what has no number."""
    d = df.withColumn("name", normalize_name(F.col("name"))).withColumn("value", parser_value(F.col("value"))).withColumn("unit", parser_unit(F.col("unit")))
    d = d.filter((F.col("name") != "") & (F.col("value") != "") & F.col("name").rlike("[A-Za-z]") & ~is_telemetry(F.col("name"), F.col("unit")) & is_number(F.col("value")))
    return d.withColumn("unit", complete_unit(F.col("name"), F.col("unit")))


def backfill_units(df: DataFrame, *group: str, order: str = "pos") -> DataFrame:
    """AGG-13: a row without unit takes that of the last row of its group with the same name key and value that has one."""
    whole = Window.partitionBy(*group, name_key(F.col("name")), F.col("value")).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), F.last(F.nullif("unit", F.lit("")), ignorenulls=True).over(whole)))


def collapse_variants(df: DataFrame, *group: str, order: str = "pos") -> DataFrame:
    """AGG-12: of rows of equal name key, value and unit, the longest name stays, at the place of the first. As a unit is in the key, its filling decides nothing here."""
    keys = [*[F.col(g) for g in group], name_key(F.col("name")), F.col("value"), F.lower(F.coalesce("unit", F.lit("")))]
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc(F.length("name")), order))
    return df.withColumn("first_pos", F.min(order).over(w)).withColumn("r", best).filter("r = 1").drop("r")


def postprocess(df: DataFrame, *group: str, order: str = "pos") -> DataFrame:
    """STR-21: the whole clean-up of a group's measurements."""
    return collapse_variants(backfill_units(clean_measurements(df), *group, order=order), *group, order=order)


def best_confidence(df: DataFrame, *group: str, order: str = "pos") -> DataFrame:
    """AGG-11: of rows of equal lower-case name, value and lower-case unit, the most confident; of equals the first."""
    keys = [*[F.col(g) for g in group], F.lower("name"), F.col("value"), F.lower(F.coalesce("unit", F.lit("")))]
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), order))
    return df.withColumn("r", r).filter("r = 1").drop("r")


def first_distinct(df: DataFrame, *group: str, order: str = "pos") -> DataFrame:
    """SET-3: of rows of equal lower-case name, value and unit, the first."""
    keys = [*[F.col(g) for g in group], *[F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "value", "unit")]]
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("r", r).filter("r = 1").drop("r")


def batch_status(lines: Column, measurements: Column, error: Column) -> Column:
    """FLT-13: 2 if a line needs a look, 3 for lines and measurements, 1 for either or an error, else 0."""
    look = F.exists(lines, lambda x: x["manual_verify_required"] | (F.trim(x["fallback_trigger_reason"]) == "char_count_mismatch") | ~F.coalesce(x["line_ocr_count_matches"], F.lit(True)) | F.lower(F.trim(x["review_status"])).isin("review_required", "review_retry_improved"))
    said = F.exists(lines, lambda x: F.trim(x["text"]) != "")
    made = F.exists(measurements, lambda x: (F.trim(x["name"]) != "") | (F.trim(x["value"]) != ""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(look), 2).when(yes(said) & yes(made), 3).when(yes(said) | yes(made) | error.isNotNull(), 1).otherwise(0)


def should_validate(mode: Column, n_lines: Column, n_measurements: Column, uncertain: Column, fallbacks: Column, disagreements: Column, least: tuple[int, int, int] = (1, 1, 1)) -> Column:
    """FLT-14: whether a panel goes to the validator."""
    m = F.lower(F.trim(mode))
    few = (n_measurements == 0) | (uncertain >= least[0]) | (fallbacks >= least[1]) | (disagreements >= least[2])
    return F.when(m.isin("", "off", "disabled", "0", "false", "no") | (n_lines == 0), False).when(m == "always", True).when(m.isin("selective", "auto"), few).otherwise(False)


def running_accuracy(events: DataFrame, *order: str) -> DataFrame:
    """AGG-24, WIN-12: running counts of approved and corrected events (0 or 1 each), accuracy so far and its highest so far.

    The order is over all events: sums of ranges come first, so that no task holds them all. See prefix_sums().
    """
    d = prefix_sums(events, ["approved", "corrected"], *order)
    total = F.col("approved_sum") + F.col("corrected_sum")
    return d.withColumn("accuracy", F.when(total > 0, F.col("approved_sum") / total).otherwise(0.0))


def prefix_sums(df: DataFrame, sums: list[str], *order: str, parts: int = 64) -> DataFrame:
    """Adds c_sum for each column c: its sum over all rows up to this one. Rows are dealt into ranges of the first order column by its quantiles.

    Ranges are summed by themselves, and the few sums before each are added by a broadcast join (of at most parts rows).
    """
    first = order[0]
    kind = dict(df.dtypes)[first]
    key = F.unix_micros(F.col(first).cast("timestamp")) if kind.startswith("timestamp") else F.col(first)
    edges = df.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.005)
    part = F.lit(0)
    for e in sorted(set(edges)):
        part = part + F.when(key.cast("double") > e, 1).otherwise(0)
    d = df.withColumn("part", part)
    totals = d.groupBy("part").agg(*[F.sum(c).alias(f"{c}_of") for c in sums])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most parts rows
    starts = totals.select("part", *[F.coalesce(F.sum(f"{c}_of").over(before), F.lit(0)).alias(f"{c}_start") for c in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"{c}_own": F.sum(c).over(own) for c in sums}).join(F.broadcast(starts), "part")
    return d.withColumns({f"{c}_sum": F.col(f"{c}_own") + F.col(f"{c}_start") for c in sums}).drop("part", *[f"{c}_own" for c in sums], *[f"{c}_start" for c in sums])


def exact_percentile(df: DataFrame, value: str, q: float, *by: str, bins: int = 4096, rounds: int = 2) -> DataFrame:
    """AGG-10: by and percentile: the value at q of each group, between neighbours by their distance. Groups are few, their rows may be many.

    Round by round, a histogram finds the bin that holds the two ranks asked for, and only what lies in it is looked at again; at
    last, its different values are counted in order. No task gathers a group's values. Null values don't count.
    """
    d = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    rank = F.lit(q) * (F.col("n") - 1)
    state = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.select(*by, F.floor(rank).alias("first"), F.ceil(rank).alias("second"), (rank - F.floor(rank)).alias("share"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    facts = ["first", "second", "share", "below"]
    for r in range(rounds + 1):
        inside = d.join(F.broadcast(state), [*by]).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        step = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
        counts = inside.withColumn("bin", F.col("v") if r == rounds else step).groupBy(*by, "bin", *facts).agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts = counts.withColumn("end", F.col("below") + F.sum("k").over(upto)).withColumn("start", F.col("end") - F.col("k"))
        holds = lambda c: (F.col("start") <= F.col(c)) & (F.col(c) < F.col("end"))
        found = counts.filter(holds("first") | holds("second"))
        state = found.groupBy(*by, "first", "second", "share").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.min("start").alias("below"))
    return state.select(*by, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")).alias("percentile"))


def latencies(df: DataFrame, engine: str, value: str) -> DataFrame:
    """AGG-10: number, sum, mean and exact 95th percentile of an engine's latencies."""
    sums = df.groupBy(F.col(engine).alias("engine")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total_ms"), F.round(F.avg(value), 6).alias("mean_ms"))
    p95 = exact_percentile(df.select(F.col(engine).alias("engine"), value), value, 0.95, "engine").select("engine", F.round("percentile", 6).alias("p95_ms"))
    return sums.join(F.broadcast(p95), "engine")  # a row an engine


def panel_confidence(lines: DataFrame, *panel: str) -> DataFrame:
    """AGG-8: mean confidence of a panel's lines, and their texts in order. A panel has few lines."""
    d = lines.groupBy(*panel).agg(F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return d.select(*panel, "confidence", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("combined_text"))


def in_text_order(df: DataFrame, *group: str, order: str = "pos") -> DataFrame:
    """STR-12: a group's measurements numbered in the order of their lines, from 1."""
    return df.withColumn("text_order", F.row_number().over(Window.partitionBy(*group).orderBy(order)))


def class_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """AGG-21's input: how often each letter occurs."""
    d = texts.select(F.explode(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), "")).alias("label"))
    return d.filter("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_quotas(counts: DataFrame, q: float = 0.2) -> DataFrame:
    """AGG-21: classes (label, n; few) with the target, the q-quantile of their counts, and what each lacks of it."""
    t = counts.agg(F.floor(F.percentile("n", q)).alias("target"))  # one row
    return counts.crossJoin(F.broadcast(t)).select("label", "n", "target", F.greatest(F.col("target") - F.col("n"), F.lit(0)).alias("quota"))


def class_weights(counts: DataFrame) -> DataFrame:
    """AGG-23: the greatest count over each class's."""
    top = counts.agg(F.max("n").alias("top"))  # one row
    return counts.crossJoin(F.broadcast(top)).select("label", "n", F.round(F.col("top") / F.col("n"), 9).alias("weight"))

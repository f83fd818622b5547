"""Scores of whole runs: labelled files against results, totals with their rates, unions of score files, changes between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calipra.functions.parse import structured
from calipra.functions.text import canonical_label_line, measurement_stem
from calipra.operators.evaluate import PARTS, greedy_matches, match_rates, positional_matches

#: How many examples a report of changes shows.
EXAMPLES = 100


def latest_results(results: DataFrame, key: str = "path", order: str = "version") -> DataFrame:
    """JON-1's right side: of results with one path, the last."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return results.withColumn("r", last).filter("r = 1").drop("r")


def with_status(labelled: DataFrame, results: DataFrame, key: str = "path") -> DataFrame:
    """JON-1: labelled files with the status and error of their result, or missing."""
    r = results.select(key, F.col("status").alias("found"), F.col("error").alias("said"))
    here = F.col("found").isNotNull()
    return labelled.join(r, key, "left").withColumn("status", F.coalesce("found", F.lit("missing"))).withColumn("error", F.when(here, F.col("said")).otherwise("missing headless result")).drop("found", "said")


def union_predictions(measurements: DataFrame, lines: DataFrame, *file: str) -> DataFrame:
    """SET-4: a file's measurements (pos, name, value, unit), then its raw lines (pos, text) as names; of equal ones, without regard to case, the first."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    m = measurements.select(*file, F.lit(0).alias("kind"), "pos", *[clean(F.col(c)).alias(c) for c in ("name", "value", "unit")])
    none = F.lit(None).cast("string")
    l = lines.select(*file, F.lit(1).alias("kind"), "pos", clean(F.col("text")).alias("name"), none.alias("value"), none.alias("unit")).filter("name is not null")
    both = m.unionByName(l)
    keys = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "value", "unit")]
    first = F.row_number().over(Window.partitionBy(*file, *keys).orderBy("kind", "pos"))
    place = F.row_number().over(Window.partitionBy(*file).orderBy("kind", "pos"))
    return both.withColumn("r", first).filter("r = 1").drop("r").withColumn("pos", place.cast("int")).drop("kind")


def parsed_item(text: Column) -> Column:
    """The evaluation's struct of a line: line, prefix, label, value, unit."""
    line = canonical_label_line(text)
    return F.transform(F.array(line), lambda x: F.transform(F.array(structured(x)), lambda s: F.struct(x.alias("line"), s["prefix"].alias("prefix"), s["label"].alias("label"), s["value"].alias("value"), s["unit"].alias("unit")))[0])[0]


def labelled_matches(labels: DataFrame, predictions: DataFrame, file: str = "file_name") -> DataFrame:
    """JON-4 over labels (pos, text) and predictions (pos, name, value, unit)."""
    expected = labels.select(file, F.col("pos").cast("int").alias("pos"), parsed_item(F.col("text")).alias("item"))
    joined = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("name", "value", "unit")])
    predicted = predictions.select(file, F.col("pos").cast("int").alias("pos"), parsed_item(joined).alias("item"))
    return greedy_matches(expected, predicted, file=file)


def plausible(line_match: Column, label_match: Column, value_match: Column, expected_value: Column) -> Column:
    """FLT-20: line or label match, or the value does and there is one."""
    return line_match | label_match | (value_match & expected_value.isNotNull())


def subset_scores(files: DataFrame, matches: DataFrame, predictions: DataFrame, file: str = "file_name") -> DataFrame:
    """AGG-16: one row of counts and rates over all labels, and the share of labelled files with any prediction."""
    n_files = files.select(file).distinct().agg(F.count(F.lit(1)).alias("labeled_files"))
    seen = files.select(file).join(predictions.select(file).distinct(), file, "left_semi").agg(F.countDistinct(file).alias("files_with_predictions"))
    total = matches.agg(F.count(F.lit(1)).alias("total_labels"), *[F.coalesce(F.sum(F.col(f"{k}_match").cast("int")), F.lit(0)).alias(f"{k}_matches") for k in PARTS])
    one = n_files.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(total))  # one row each
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return one.select("*", *[rate(f"{k}_matches", "total_labels").alias(f"{k}_match_rate") for k in PARTS], rate("files_with_predictions", "labeled_files").alias("detection_rate"))


def line_totals(reports: DataFrame) -> DataFrame:
    """AGG-15, EVL-2: totals of file reports and ten rates on three denominators: labels, predicted lines and files.

    reports: n_labels, n_predicted, exact, label, value, unit, prefix, uncertain, fallbacks, disagreements, segmentation_failures, roi_found.
    """
    sums = ("n_labels", "n_predicted", "exact", "label", "value", "unit", "prefix", "uncertain", "fallbacks", "disagreements", "segmentation_failures")
    t = reports.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("roi_found")).alias("roi_failures"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    of = {"n_labels": ("exact", "label", "value", "unit", "prefix"), "n_predicted": ("uncertain", "fallbacks", "segmentation_failures", "disagreements"), "n_files": ("roi_failures",)}
    return t.select("*", *[rate(c, base).alias(f"{c}_rate") for base, cs in of.items() for c in cs])


def raw_text_hits(labels: DataFrame, texts: DataFrame, file: str = "file_name") -> DataFrame:
    """AGG-17: of labels (text, value), how many a file's raw text (raw) holds, whole or by value, without regard to case and spacing."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    d = labels.join(texts.select(file, plain(F.col("raw")).alias("all")), file, "left")
    whole, value = F.col("all").contains(plain(F.col("text"))), F.col("all").contains(plain(F.col("value")))
    return d.groupBy(file).agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(whole).alias("line_hits"), F.count_if(value & F.col("value").isNotNull()).alias("value_hits"))


def split_counts(matches: DataFrame) -> DataFrame:
    """AGG-25: per split, matches that aren't whole, and those with an expected text."""
    return matches.groupBy("split").agg(F.count_if(~F.coalesce("line_match", F.lit(False))).alias("mismatch_rows"), F.count_if(F.trim(F.coalesce("expected_text", F.lit(""))) != "").alias("scored_rows"))


def union_scores(rows: DataFrame, order: str = "source_order", also: tuple[str, ...] = ()) -> DataFrame:
    """SET-5: of rows with one file and expected text, and what else tells them apart (also), from several score files, the last."""
    last = F.row_number().over(Window.partitionBy("file_name", "expected_text", *also).orderBy(F.desc(order)))
    return rows.withColumn("r", last).filter("r = 1").drop("r")


def top_changes(changes: DataFrame, *order: str, n: int = EXAMPLES) -> DataFrame:
    """SRT-7: the first n examples of each kind of change; a top-k a kind, of which there are two."""
    r = F.row_number().over(Window.partitionBy("change").orderBy(*order))
    return changes.withColumn("rank", r).filter(F.col("rank") <= n)


def match_rows(files: DataFrame, matches: DataFrame, file: str = "file_name") -> DataFrame:
    """EVL-10: a row a match with its file's columns and its number, from 1."""
    at = F.row_number().over(Window.partitionBy(file).orderBy("pos"))
    return files.join(matches, file).withColumn("line_index", at)


def panel_lines(matches: DataFrame, measurements: DataFrame, panel_sizes: DataFrame, *file: str) -> DataFrame:
    """JON-16: the panel line that each scored match (match_ix from 0) is held against: its measurement's hint if it is one of the panel's lines, else its own place.

    Adds panel_ix and, where there is no such line, reason; matches without expected text drop out.
    """
    hint = measurements.select(*file, F.col("pos").alias("match_ix"), "order_hint")
    d = matches.filter(F.trim(F.coalesce("expected_text", F.lit(""))) != "").join(hint, [*file, "match_ix"], "left").join(panel_sizes.select(*file, "n_lines"), [*file], "left")
    usable = F.coalesce("n_lines", F.lit(0))
    hinted = F.when((F.col("order_hint") >= 0) & (F.col("order_hint") < usable), F.col("order_hint"))
    ix = F.coalesce(hinted, F.when(F.col("match_ix") < usable, F.col("match_ix")))
    return d.withColumn("panel_ix", ix).withColumn("reason", F.when(ix.isNull(), "unmapped_match_index")).drop("order_hint", "n_lines")


def top_stems(matches: DataFrame, n: int = 15) -> DataFrame:
    """AGG-18, EVL-9: the stems of expected lines that fail most; a top-k."""
    d = matches.filter(~F.col("line_match")).groupBy(measurement_stem(F.col("expected_text")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "stem").limit(n)


def top_split_buckets(matches: DataFrame, n: int = 8) -> DataFrame:
    """AGG-18: the most frequent pairs of split and failure bucket; a top-k."""
    return matches.groupBy("split", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "split", "bucket").limit(n)


def rate(hits: Column, of: Column, digits: int = 6) -> Column:
    """NUM-6: a share of at least one, rounded half to even."""
    return F.bround(hits / F.greatest(of, F.lit(1)), digits)


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NUM-6."""
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def char_error_rate(pairs: DataFrame, *by: str) -> DataFrame:
    """MLD-4: of characters read (predicted) and labelled (label), how many are wrong, by group."""
    wrong = F.count_if(~F.col("predicted").eqNullSafe(F.col("label")))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong"), rate(wrong, F.count(F.lit(1))).alias("error_rate"))


def summary_row(scores: DataFrame, config: str, elapsed: float | None, skipped: str | None = None) -> DataFrame:
    """PRJ-4: a run's scores as a row of the summary; a configuration that was skipped has zeros and the reason."""
    return scores.select(F.lit(config).alias("config"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in scores.columns], F.lit(elapsed or 0.0).alias("elapsed_s"), F.lit(skipped).cast("string").alias("skipped"))


def write_run(summary: DataFrame, matches: DataFrame, path: str) -> None:
    """SNK-8: a run's summary as CSV and JSON lines, and its line matches as CSV; folders of their own, so that writers need no single task."""
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary_csv")
    summary.write.mode("overwrite").json(f"{path}/summary_json")
    matches.write.mode("overwrite").option("header", True).csv(f"{path}/line_matches_csv")


def ab_rates(expected: DataFrame, raw: DataFrame, normalised: DataFrame) -> DataFrame:
    """EVL-7, EVL-6: match rates by place of a raw and a normalised reading of the same lines."""
    one = match_rates(positional_matches(expected, raw)).withColumn("reading", F.lit("raw"))
    return one.unionByName(match_rates(positional_matches(expected, normalised)).withColumn("reading", F.lit("normalised")))

"""Further queries: candidates, reranking, recovery of lines, vectors, batches and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calipra.functions.parse import parses, with_parsed, with_parses
from calipra.functions.text import char_count, name_key
from calipra.operators import candidates, configs, lexicon, pixels, recover, rerank, results, summaries
from calipra.plans.catalog import parsed, query
from calipra.plans.fixtures import SQL_LINES, lines, read
from calipra.sources import records
from calipra.sources.scratch import written


def _readings(d: DataFrame) -> DataFrame:
    """Two readings of each line: as labelled, less sure, and as predicted."""
    base = d.select(F.col("file_name").alias("panel_id"), F.col("pos").alias("line_order"), "confidence", "text", "pred_text")
    one = base.select("panel_id", "line_order", F.lit(0).alias("cand_pos"), F.col("pred_text").alias("text"), "confidence", F.lit("primary").alias("source"))
    two = base.select("panel_id", "line_order", F.lit(1).alias("cand_pos"), F.col("text").alias("text"), (F.col("confidence") - 0.05).alias("confidence"), F.lit("fallback_multiview").alias("source"))
    return one.unionByName(two)


def readings(spark, sf_dir) -> DataFrame:
    return with_parsed(_readings(lines(spark, sf_dir)))


def _lexicon_and_readings(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    """The lexicon of the train split, and two readings of all lines. Lines are made once, and each different text is parsed once."""
    d = written(lines(spark, sf_dir).select("file_name", "split", "pos", "confidence", "text", "pred_text"), "lines")
    known = written(parses(d.select("text"), d.select("pred_text")), "parses")
    return rerank.build(with_parses(lexicon.of_splits(d, "train"), known)), with_parses(_readings(d), known)


_READINGS = f"""{SQL_LINES},
r AS (
  SELECT file_name AS panel_id, pos AS line_order, 0 AS cand_pos, g_text AS text, pred_len AS len, confidence, g_unit IS NOT NULL AS has_unit FROM (SELECT *, length(g_text) + CASE corruption WHEN 4 THEN -1 WHEN 5 THEN 5 ELSE 0 END + CASE WHEN corruption = 0 AND unit = 'mmHg' THEN -1 ELSE 0 END AS pred_len FROM got)
  UNION ALL SELECT file_name, pos, 1, text, length(text), confidence - 0.05, true FROM got),
q AS (SELECT *, 0.1 + greatest(0, least(confidence, 1)) * 0.15 + 0.2 + 0.15 + 0.15 + CASE WHEN has_unit THEN 0.1 ELSE 0 END + 0.35 AS quality FROM r)"""


def _quality(spark, sf_dir):
    return readings(spark, sf_dir).withColumn("quality", candidates.quality(F.col("canonical"), F.col("parsed"), F.col("confidence")))


@query(f"WITH {_READINGS} SELECT panel_id, line_order, CAST(cand_pos AS INTEGER) AS cand_pos, text AS canonical, round(quality, 9) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, line_order ORDER BY round(quality, 9) DESC, confidence DESC, len DESC, cand_pos = 0 DESC, cand_pos) AS k FROM q) WHERE k = 1")
def candidate_quality_top1(spark, sf_dir):
    d = candidates.rank(_quality(spark, sf_dir).withColumn("quality", F.round("quality", 9)), "panel_id", "line_order")
    return d.filter("rank = 1").select("panel_id", "line_order", "cand_pos", "canonical", "quality")


@query(f"WITH {_READINGS}, b AS (SELECT *, max(quality) OVER (PARTITION BY panel_id, line_order) AS best FROM q) SELECT panel_id, line_order, CAST(cand_pos AS INTEGER) AS cand_pos FROM b WHERE round(quality - best, 9) >= -0.22 AND (best < 0.95 OR quality >= 0.45)")
def candidate_prune(spark, sf_dir):
    return candidates.prune(_quality(spark, sf_dir), "panel_id", "line_order").select("panel_id", "line_order", "cand_pos")


@query(f"""WITH {SQL_LINES},
s AS (SELECT lower(label) AS family, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi, avg(CAST(value AS DOUBLE)) AS mean FROM got WHERE split = 'train' GROUP BY ALL),
v AS (SELECT file_name, pos, g_value AS value, CAST(g_value AS DOUBLE) AS x, greatest(0, lo * 0.75) AS a, greatest(hi * 1.25, mean * 1.25) AS b FROM got JOIN s ON lower(label) = family)
SELECT file_name, pos, value, x BETWEEN a AND b AS in_range FROM v""")
def range_test(spark, sf_dir):
    d = parsed(spark, sf_dir, "pred_text")
    s = lexicon.value_stats(lexicon.of_splits(parsed(spark, sf_dir), "train"))
    j = d.withColumn("family", F.col("parsed.family")).join(s, "family")
    return j.select("file_name", "pos", F.col("parsed.value").alias("value"), rerank.in_range(F.col("parsed.value").cast("double"), F.col("min_value"), F.col("max_value"), F.col("mean_value")).alias("in_range"))


@query(f"""WITH {SQL_LINES},
s AS (SELECT lower(label) AS family, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi, avg(CAST(value AS DOUBLE)) AS mean FROM got WHERE split = 'train' GROUP BY ALL),
v AS (SELECT file_name, pos, g_value AS value, CAST(g_value AS DOUBLE) AS x, greatest(0, lo * 0.75) AS a, greatest(hi * 1.25, mean * 1.25) AS b FROM got JOIN s ON lower(label) = family),
r AS (
  SELECT file_name, pos, value, CASE WHEN x NOT BETWEEN a AND b AND x * 0.1 BETWEEN a AND b THEN x * 0.1 WHEN x NOT BETWEEN a AND b AND x * 10.0 BETWEEN a AND b THEN x * 10.0
    WHEN regexp_matches(value, '^1[^.]') AND CAST(substr(value, 2) AS DOUBLE) BETWEEN a AND b THEN CAST(substr(value, 2) AS DOUBLE) END AS y FROM v)
SELECT file_name, pos, value, regexp_replace(printf('%.1f', y), '\\.?0+$', '') AS repaired FROM r WHERE y IS NOT NULL""")
def value_repairs(spark, sf_dir):
    d = parsed(spark, sf_dir, "pred_text")
    s = lexicon.value_stats(lexicon.of_splits(parsed(spark, sf_dir), "train"))
    j = d.withColumn("family", F.col("parsed.family")).join(s, "family")
    return j.select("file_name", "pos", F.col("parsed.value").alias("value"), rerank.repaired_value(F.col("parsed.value"), F.col("min_value"), F.col("max_value"), F.col("mean_value")).alias("repaired")).filter("repaired is not null")


@query()
def family_repair(spark, sf_dir):
    lex, c = _lexicon_and_readings(spark, sf_dir)
    return rerank.repaired_texts(written(c.filter("cand_pos = 0"), "readings"), lex).select("panel_id", "line_order", "text", "confidence", "source")


@query()
def panel_rerank(spark, sf_dir):
    """Lines of one kind, which have the same place and texts, are parsed, repaired and scored once."""
    by = ["kind_a", "kind_b"]
    d = lines(spark, sf_dir).select("file_name", "split", "pos", "confidence", "text", "pred_text")
    d = written(d.select("*", F.xxhash64("pos", "text", "pred_text").alias("kind_a"), F.xxhash64(F.lit(1), "pos", "text", "pred_text").alias("kind_b")), "lines")
    kinds = written(d.groupBy(*by, "pos", "text", "pred_text").agg(F.count_if(F.lower(F.trim("split")) == "train").alias("weight")), "kinds")
    known = written(parses(kinds.select("text"), kinds.select("pred_text")), "parses")
    labelled = with_parses(kinds.filter("weight > 0"), known)
    ordered = lexicon.of_splits(d, "train").select("split", "file_name", "pos", *by).join(labelled.select(*by, "canonical", F.struct("parsed.family").alias("parsed")), by)
    lex = rerank.build(labelled, ordered)
    c = _readings(kinds.select(F.struct(*by).alias("file_name"), "pos", F.lit(1.0).alias("confidence"), "text", "pred_text"))
    c = written(rerank.augment(written(with_parses(c.withColumn("loss", F.lit(0.0)), known), "readings"), lex), "candidates")
    scored = rerank.with_terms(rerank.with_similarity(c, lex), lex).select("panel_id.*", "*")
    own = d.select(F.col("file_name").alias("panel_id"), F.col("pos").alias("line_order"), *by, F.array("confidence", F.col("confidence") - 0.05).alias("confidences"))
    return rerank.rerank_lines(own, scored, lex["transitions"], by)


@query(f"WITH {SQL_LINES} SELECT file_name AS blob_id, string_agg(text, chr(10) ORDER BY pos) AS lines, CASE WHEN count(*) = 1 THEN 'raw_newlines' ELSE 'unit_boundary_split' END AS source FROM got GROUP BY file_name")
def blob_recovery(spark, sf_dir):
    d = lines(spark, sf_dir)
    b = d.groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"), F.count(F.lit(1)).cast("int").alias("target_line_count"))
    b = b.select(F.col("file_name").alias("blob_id"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), "target_line_count")
    return recover.recover_lines(b).select("blob_id", F.array_join("lines", "\n").alias("lines"), "source")


# vectors, batches, configurations


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT vec_id, label, v, list_transform(v, lambda x: x - list_avg(v)) AS c FROM v),
u AS (SELECT vec_id, label, v, c, sqrt(list_inner_product(c, c)) AS n FROM c),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS source_id, round(greatest(-1, least(1, list_inner_product(a.c, b.c) / (a.n * b.n))), 6) AS score
  FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, source_id))
SELECT query_id, CASE WHEN reason = '' THEN source_id END AS source_id, score, reason = '' AS matched, reason FROM (
  SELECT *, CASE WHEN score < 0.72 THEN 'score_below_threshold' WHEN score - second < 0.015 THEN 'ambiguous_top_match' ELSE '' END AS reason FROM r WHERE r = 1)""")
def vector_source_match(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    m = pixels.vector_matches(e.filter("vec_id % 20 = 0"), e, "label", "vec_id", "embedding")
    return pixels.best_sources(m.withColumn("score", F.round("score", 6)).withColumn("mae", F.lit(0.0)))


@query(f"""WITH {SQL_LINES},
i AS (SELECT file_name, max(CASE WHEN corruption = 4 THEN 1 ELSE 0 END) AS look, count(*) AS n FROM got GROUP BY file_name)
SELECT file_name, CAST(CASE WHEN look = 1 THEN 2 ELSE 3 END AS INTEGER) AS status FROM i""")
def batch_status(spark, sf_dir):
    d = lines(spark, sf_dir)
    one = F.struct(F.col("pred_text").alias("text"), F.lit(False).alias("manual_verify_required"), F.when(F.col("corruption") == 4, "char_count_mismatch").otherwise("none").alias("fallback_trigger_reason"), F.lit(True).alias("line_ocr_count_matches"), F.lit("accepted").alias("review_status"))
    items = d.groupBy("file_name").agg(F.collect_list(one).alias("l"), F.collect_list(F.struct(F.col("label").alias("name"), "value")).alias("m"))
    return items.select("file_name", results.batch_status(F.col("l"), F.col("m"), F.lit(None)).alias("status"))


@query(f"WITH {SQL_LINES} SELECT split_part(file_name, '0', 1) AS patient, file_name AS exam, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY pos) AS combined_text FROM got GROUP BY ALL")
def panel_text(spark, sf_dir):
    d = lines(spark, sf_dir).groupBy(F.split_part("file_name", F.lit("0"), F.lit(1)).alias("patient"), F.col("file_name").alias("exam"))
    d = d.agg(F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return d.select("patient", "exam", "n_lines", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("combined_text"))


@query(f"""WITH {SQL_LINES},
f AS (SELECT left(file_name, length(file_name) - 1) AS patient, CASE WHEN split = 'train' THEN 'a' ELSE 'b' END AS exam, file_name, string_agg(text, '|' ORDER BY text) AS l FROM got GROUP BY file_name, split),
e AS (SELECT patient, exam, exam || '=' || string_agg(file_name || ':ok:' || l, ';' ORDER BY file_name) AS t FROM f GROUP BY patient, exam)
SELECT patient, count(*)::INT AS n_exams, string_agg(t, chr(10) ORDER BY exam) AS exams FROM e GROUP BY patient""")
def nested_predictions(spark, sf_dir):
    """Patients are runs of ten files, exams their splits; the nested rows are written out as text to be compared."""
    d = lines(spark, sf_dir)
    items = d.groupBy("file_name", "split").agg(F.sort_array(F.collect_list("text")).alias("lines"))
    n = records.nested(items.select(F.expr("left(file_name, length(file_name) - 1)").alias("patient"), F.when(F.col("split") == "train", "a").otherwise("b").alias("exam"), F.col("file_name").alias("dicom_path"), F.lit("ok").alias("status"), "lines"))
    dicom = lambda x: F.concat_ws(":", x["dicom_path"], x["status"], F.array_join(x["lines"], "|"))
    exam = lambda e: F.concat(e["exam"], F.lit("="), F.array_join(F.transform(e["dicoms"], dicom), ";"))
    return n.select("patient", F.size("exams").alias("n_exams"), F.array_join(F.transform("exams", exam), "\n").alias("exams"))


@query(f"WITH {SQL_LINES} SELECT file_name, pos, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS key, CAST(length(replace(text, ' ', '')) AS INTEGER) AS n_chars FROM got")
def name_keys(spark, sf_dir):
    d = lines(spark, sf_dir)
    return d.select("file_name", "pos", name_key(F.col("text")).alias("key"), char_count(F.col("text")).alias("n_chars"))


@query(f"WITH {SQL_LINES} SELECT file_name, max(pos) AS n, bool_and(coalesce(CAST(prefix AS INTEGER) >= before, true)) AS consistent FROM (SELECT *, lag(CAST(prefix AS INTEGER)) OVER (PARTITION BY file_name, prefix IS NULL ORDER BY pos) AS before FROM got) GROUP BY file_name")
def prefix_order(spark, sf_dir):
    """WIN-3: whether a file's prefixes never fall."""
    d = lines(spark, sf_dir).withColumn("k", F.col("prefix").cast("int"))
    before = F.lag("k").over(Window.partitionBy("file_name", F.col("prefix").isNull()).orderBy("pos"))
    return d.withColumn("b", before).groupBy("file_name").agg(F.max("pos").alias("n"), F.every(F.coalesce(F.col("k") >= F.col("b"), F.lit(True))).alias("consistent"))


@query("SELECT 'om_' || i || '_' || r || '_s' || s || '_' || b || '_' || o || CASE WHEN b = 'otsu' THEN '_mc' ELSE '' END || '_' || m AS name FROM (SELECT unnest(['gray','bgr']) AS i), (SELECT unnest(['pln','ush']) AS r), (SELECT unnest([1,2,3]) AS s), (SELECT unnest(['nbin','otsu']) AS b), (SELECT unnest(['st','ts']) AS o), (SELECT unnest(['mv0','mv1']) AS m) WHERE (b = 'otsu' OR o = 'st') AND (b = 'nbin' OR s > 1)")
def config_factorial(spark, sf_dir):
    return configs.factorial(spark, [1, 2, 3], ["none", "otsu"], ["st", "ts"], ["plain", "unsharp"], ["gray", "bgr"], ["none", "pipeline"]).select("name")


@query("SELECT conv_id, turn, false AS runs FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, turn, turn >= 2 FROM conversations WHERE turn > 0")
def validator_gate(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    runs = results.should_validate(F.lit("selective"), F.col("turn"), F.lit(5), F.col("turn"), F.lit(0), F.lit(0), (2, 1, 1))
    return c.select("conv_id", "turn", runs.alias("runs"))


# summaries


@query("SELECT l_orderkey AS path, count(*) AS n_frames FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_returnflag = 'R' THEN 1 END) = 0")
def never_found(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_returnflag") == "R", 1).alias("roi"))
    return summaries.never_found(d)


@query("SELECT count(*) AS n_files, count(*) FILTER (event_type = 'error') AS n_failed, CAST(sum(value) AS DOUBLE) AS total_s, CAST(round(avg(value), 6) AS DOUBLE) AS mean_s FROM (SELECT event_type, CAST(value AS DECIMAL(18, 6)) AS value FROM events)")
def load_summary(spark, sf_dir):
    d = read(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").cast("decimal(18,6)").alias("duration"))
    return summaries.load_summary(d).withColumns({c: F.col(c).cast("double") for c in ("total_s", "mean_s")})


@query("SELECT event_id AS path, value AS duration FROM events ORDER BY value DESC, event_id LIMIT 5")
def slowest_loads(spark, sf_dir):
    return summaries.slowest(read(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("value").alias("duration")))


@query("SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem")
def value_moments(spark, sf_dir):
    return summaries.value_moments(read(spark, sf_dir, "lineitem"), "l_quantity")


@query(f"WITH {SQL_LINES} SELECT file_name, array_to_string(list_sort(list_distinct(list(engine_name))), ',') AS sources FROM got GROUP BY file_name")
def distinct_sources(spark, sf_dir):
    d = lines(spark, sf_dir).select("file_name", F.col("engine_name").alias("source"))
    return summaries.distinct_sources(d, "file_name").select("file_name", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {SQL_LINES} SELECT file_name, pos, CAST(row_number() OVER (PARTITION BY file_name ORDER BY pos) - 1 AS INTEGER) AS text_order FROM got WHERE corruption <> 2")
def remapped_orders(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("text", F.when(F.col("corruption") == 2, " ").otherwise(F.col("text")))
    return summaries.remap_orders(d, "file_name", order="pos").select("file_name", "pos", "text_order")

"""Queries of runs: failures that are most frequent, rates, second passes, engines replayed, candidates of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from calipra.operators import assembly, results, scoring
from calipra.plans.catalog import query
from calipra.plans.fixtures import SQL_LINES, lines, read
from calipra.sources import records
from calipra.sources.scratch import scratch_path


@query(f"WITH {SQL_LINES}, s AS (SELECT array_to_string(string_split(label, ' ')[1:3], ' ') AS stem, count(*) AS n FROM got WHERE corruption < 3 GROUP BY ALL) SELECT * FROM s ORDER BY n DESC, stem LIMIT 15")
def stems_that_fail(spark, sf_dir):
    return scoring.top_stems(lines(spark, sf_dir).select(F.col("text").alias("expected_text"), (F.col("corruption") >= 3).alias("line_match")))


@query(f"WITH {SQL_LINES}, s AS (SELECT split, CASE WHEN corruption < 2 THEN 'a' ELSE engine_name END AS bucket, count(*) AS n FROM got GROUP BY ALL) SELECT * FROM s ORDER BY n DESC, split, bucket LIMIT 8")
def buckets_of_splits(spark, sf_dir):
    return scoring.top_split_buckets(lines(spark, sf_dir).select("split", F.when(F.col("corruption") < 2, "a").otherwise(F.col("engine_name")).alias("bucket")))


@query(f"WITH {SQL_LINES} SELECT file_name, greatest(0, least(max(confidence) * 1.02, 1))::DOUBLE AS top, round_even(count(*) FILTER (corruption = 1) / greatest(count(*) FILTER (corruption < 3), 1), 6) AS share FROM got GROUP BY file_name")
def shares_of_files(spark, sf_dir):
    c = F.col("corruption")
    return lines(spark, sf_dir).groupBy("file_name").agg(scoring.clamped(F.max("confidence") * 1.02).alias("top"), scoring.rate(F.count_if(c == 1), F.count_if(c < 3)).alias("share"))


@query(f"WITH {SQL_LINES} SELECT engine_name, count(*) AS n, count(*) FILTER (corruption IN (0, 1, 2)) AS wrong, round_even(count(*) FILTER (corruption IN (0, 1, 2)) / count(*), 6) AS error_rate FROM got GROUP BY ALL")
def errors_of_characters(spark, sf_dir):
    c = F.col("corruption")
    d = lines(spark, sf_dir).select("engine_name", F.when(c != 0, F.left("label", F.lit(1))).alias("label"), F.when(c.isin(1, 2), "?").otherwise(F.left("label", F.lit(1))).alias("predicted"))
    return scoring.char_error_rate(d, "engine_name")


@query(f"WITH {SQL_LINES}, r AS (SELECT count(*) AS n_lines, sum(CAST(corruption > 5 OR corruption IN (3, 4, 5) AS INT))::BIGINT AS line_n FROM got) SELECT 'normalised' AS reading, n_lines, n_lines AS line_n FROM r UNION ALL SELECT 'raw', n_lines, (SELECT count(*) FILTER (corruption > 5 OR corruption = 3 OR (corruption = 0 AND unit NOT IN ('cm', 'mmHg', 'm/s')))::BIGINT FROM got) FROM r")
def raw_and_normalised(spark, sf_dir):
    d = lines(spark, sf_dir)
    item = lambda text: d.select("file_name", "pos", F.struct(text.alias("line"), "prefix", "label", "value", "unit").alias("item"))
    return scoring.ab_rates(item(F.col("text")), item(F.col("pred_text")), item(F.col("text"))).select("reading", "n_lines", "line_n")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def stamps_of_events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", assembly.utc_stamp(F.col("ts")).alias("stamp"))


@query(f"WITH {SQL_LINES} SELECT file_name, string_agg(DISTINCT engine_name, ',' ORDER BY engine_name) AS engines FROM got WHERE corruption <> 1 GROUP BY file_name")
def engines_of_files(spark, sf_dir):
    d = lines(spark, sf_dir).groupBy("file_name").agg(F.collect_list(F.when(F.col("corruption") == 1, None).otherwise(F.col("engine_name"))).alias("e"))
    return d.select("file_name", F.array_join(assembly.sorted_distinct(F.col("e")), ",").alias("engines")).filter("engines <> ''")


@query(f"WITH {SQL_LINES} SELECT file_name, CASE WHEN max(corruption) > 7 THEN min(text) END AS extra FROM got GROUP BY file_name")
def second_pass(spark, sf_dir):
    d = lines(spark, sf_dir).groupBy(F.col("file_name").alias("dicom_path")).agg(F.collect_list(F.when(F.col("corruption") > 7, F.col("label"))).alias("measurements"), F.min("text").alias("extra"))
    return assembly.enriched(d.drop("extra"), d.select("dicom_path", "extra")).select(F.col("dicom_path").alias("file_name"), "extra")


@query(f"WITH {SQL_LINES} SELECT file_name, pos, CASE WHEN row_number() OVER (PARTITION BY file_name ORDER BY pos) <= 3 THEN text ELSE '' END AS text FROM got")
def replayed_results(spark, sf_dir):
    d = lines(spark, sf_dir)
    return assembly.replayed(d.select("file_name", "pos"), d.filter("pos <= 3").select("file_name", F.col("pos").alias("place"), "text")).select("file_name", "pos", "text")


@query(f"WITH {SQL_LINES} SELECT file_name, pos, CASE WHEN corruption = 1 THEN text ELSE text || chr(10) || text END AS text FROM got")
def normalised_results(spark, sf_dir):
    raw = F.concat_ws("\n", F.concat("text", F.lit("  ____")), F.lit(" .. "), F.when(F.col("corruption") != 1, F.concat(F.lit(" "), "text")))
    return assembly.normalising(lines(spark, sf_dir).select("file_name", "pos", raw.alias("text")))


@query("""WITH f AS (SELECT o_orderkey AS path, o_custkey AS exam, o_orderkey % 3 AS study, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 END AS rows, 2 + o_orderkey % 4 AS n FROM orders),
p AS (SELECT a.path, b.path AS candidate, a.study = b.study AS same FROM f a JOIN f b ON a.exam = b.exam AND a.path <> b.path AND b.n > 2 AND (a.rows IS NULL OR b.rows IS NULL OR a.rows = b.rows))
SELECT path, candidate, same FROM (SELECT *, bool_or(same) OVER (PARTITION BY path) AS any_same FROM p) WHERE same OR NOT any_same""")
def candidates_of_sources(spark, sf_dir):
    k = F.col("o_orderkey")
    f = read(spark, sf_dir, "orders").select(k.alias("path"), F.col("o_custkey").alias("exam"), (k % 3).alias("study"), F.when(k % 5 > 0, k % 2).alias("rows"), F.lit(7).alias("cols"), (1 + k % 4).alias("n_frames"))
    return assembly.source_candidates(f.drop("n_frames"), f)


@query(f"WITH {SQL_LINES} SELECT file_name AS path, pos, pos AS taken, round(CASE WHEN corruption = 1 THEN 3 ELSE 5 END + confidence, 6) AS score FROM got")
def matches_of_companions(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("name", F.concat_ws(" ", "pos", "label"))
    rows = d.select(F.col("file_name").alias("path"), "pos", "name", F.when(F.col("corruption") == 1, "none").otherwise(F.col("value")).alias("value"), F.col("pos").cast("string").alias("unit"), "confidence")
    clean = d.select(F.col("file_name").alias("path"), "pos", "name", "value", F.col("pos").cast("string").alias("unit"))
    return assembly.companion_matches(clean, rows).withColumn("score", F.round("score", 6))


@query(f"WITH {SQL_LINES} SELECT file_name AS dicom_path, count(*) AS n FROM got GROUP BY file_name")
def checkpoint_batches(spark, sf_dir):
    """A checkpoint of two batches, read again as one."""
    path = scratch_path(spark, "checkpoint")
    d = lines(spark, sf_dir).groupBy(F.col("file_name").alias("dicom_path"), "split").agg(F.collect_list(F.struct(F.col("label").alias("name"), "value")).alias("measurements"))
    for split in ("train", "validation"):
        records.append_items(d.filter(F.col("split") == split).select("dicom_path", F.lit("ok").alias("status"), "measurements"), path)
    return records.read_items(spark, path).select("dicom_path", F.size("measurements").cast("long").alias("n"))


@query(f"WITH {SQL_LINES} SELECT 'A' AS config, count(*) AS n, 1.5::DOUBLE AS elapsed_s FROM got")
def summaries_of_runs(spark, sf_dir):
    path = scratch_path(spark, "run")
    d = lines(spark, sf_dir)
    scoring.write_run(scoring.summary_row(d.agg(F.count(F.lit(1)).alias("n")), "A", 1.5), d.select("file_name", "pos", "text"), path)
    back = spark.read.schema("config string, n long, elapsed_s double").json(f"{path}/summary_json")
    n = spark.read.option("header", True).csv(f"{path}/line_matches_csv").agg(F.count(F.lit(1)).alias("lines"))  # one row
    return back.crossJoin(F.broadcast(n)).filter("n = lines").drop("lines")


@query(f"WITH {SQL_LINES} SELECT file_name, round(avg(confidence), 6) AS confidence, string_agg(text, chr(10) ORDER BY pos) AS combined_text FROM got GROUP BY file_name")
def confidences_of_panels(spark, sf_dir):
    return results.panel_confidence(lines(spark, sf_dir), "file_name").withColumn("confidence", F.round("confidence", 6))

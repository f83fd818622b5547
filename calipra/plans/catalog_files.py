"""Queries that write records of runs as files and read them back, and of files found."""

from __future__ import annotations

from pyspark.sql import functions as F

from calipra.functions.spacing import repaired_lines
from calipra.operators import lexicon
from calipra.plans.catalog import query
from calipra.plans.catalog_cases import _cases, _values
from calipra.plans.fixtures import SQL_LINES, lines, read
from calipra.sources import files, records
from calipra.sources.scratch import scratch_path


@query(f"WITH {SQL_LINES} SELECT '/d/' || file_name AS file_path, file_name, split, CAST(row_number() OVER (PARTITION BY file_name ORDER BY pos) AS INTEGER) AS pos, CAST(pos AS INTEGER) AS line_order, text FROM got")
def labels_round_trip(spark, sf_dir):
    d = lines(spark, sf_dir).select("file_name", F.concat(F.lit("/d/"), "file_name").alias("file_path"), F.upper("split").alias("split"), "pos", F.concat(F.lit(" "), "text").alias("text"))
    path = scratch_path(spark, "labels")
    records.write_labels(d, path)
    return records.read_labels(spark, path, strict_order=True).select("file_path", "file_name", "split", "pos", "line_order", "text")


@query(f"WITH {SQL_LINES} SELECT file_name, split, CAST(row_number() OVER (PARTITION BY file_name ORDER BY pos) - 1 AS INTEGER) AS line_index, text AS expected_text, corruption > 4 AS full_match FROM got")
def scores_round_trip(spark, sf_dir):
    c = F.col("corruption")
    m = F.struct("pos", F.struct(F.col("text").alias("expected_text"), F.col("pred_text").alias("predicted_text"), (c > 4).alias("full_match"), (c > 4).alias("line_match")).alias("m"))
    f = lines(spark, sf_dir).groupBy("file_name", "split").agg(F.sort_array(F.collect_list(m)).alias("m"))
    path = scratch_path(spark, "scores")
    records.write_scores(f.select("file_name", "split", F.transform("m", lambda x: x["m"]).alias("matches")), path)
    return records.read_scores(spark, path).select("file_name", "split", "line_index", "expected_text", "full_match")


@query(f"""WITH {SQL_LINES}, f AS (SELECT file_name, max(corruption) AS top FROM got GROUP BY file_name)
SELECT file_name AS dicom_path, CASE WHEN top = 9 THEN 'error' ELSE 'ok' END AS status, CASE WHEN top = 9 THEN '' ELSE label END AS name, CASE WHEN top = 9 THEN '' ELSE value END AS value, CASE WHEN top = 9 THEN 'C:\\new' ELSE '' END AS error
FROM got JOIN f USING (file_name) WHERE top <> 8 AND (top <> 9 OR pos = 1)""")
def items_round_trip(spark, sf_dir):
    """Files whose top corruption is 8 are lines that are no JSON, those of 9 are ones with single backslashes."""
    m = F.struct(F.col("label").alias("name"), "value", "unit")
    d = lines(spark, sf_dir).groupBy("file_name").agg(F.max("corruption").alias("top"), F.array_sort(F.collect_list(m)).alias("measurements"))
    good = F.to_json(F.struct(F.col("file_name").alias("dicom_path"), F.lit("ok").alias("status"), "measurements"))
    failed = F.concat(F.lit('{"dicom_path":"'), "file_name", F.lit('","status":"error","measurements":[],"error":{"type":"OSError","message":"C:\\new"}}'.replace("\\n", "\\q")))
    line = F.when(F.col("top") == 8, F.lit('{"dicom_path": ')).when(F.col("top") == 9, failed).otherwise(good)
    path = scratch_path(spark, "items")
    d.select(line.alias("value")).write.text(path)
    return records.flat_items(records.read_items(spark, path)).select("dicom_path", "status", "name", "value", F.replace("error", F.lit("\\q"), F.lit("\\n")).alias("error"))


@query(f"WITH {SQL_LINES} SELECT file_name, text AS expected_text, CASE WHEN corruption <> 2 THEN value END AS predicted_text FROM got")
def failures_round_trip(spark, sf_dir):
    d = lines(spark, sf_dir).select(F.col("file_name").alias("file"), F.col("text").alias("expected"), F.when(F.col("corruption") != 2, F.col("value")).alias("actual"))
    path = scratch_path(spark, "failures")
    d.write.option("header", True).csv(path)
    return records.read_failures(spark, path)


@query("SELECT DISTINCT o_orderpriority AS path FROM orders")
def allow_lists(spark, sf_dir):
    path = scratch_path(spark, "allow")
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("value")).distinct()
    o.union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return files.allow_list(spark, path)


@query("SELECT n_regionkey AS region, 1 AS found, 1 AS found_any_case, 1 AS newest FROM nation GROUP BY n_regionkey")
def found_files(spark, sf_dir):
    """A file a region, found by both ways of matching names, and by time."""
    path = scratch_path(spark, "found")
    read(spark, sf_dir, "nation").select("n_regionkey", "n_name").coalesce(1).write.partitionBy("n_regionkey").text(path)
    region = F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int")
    one, two = files.discover(spark, path, "part-*.txt"), files.discover(spark, path, "PART-*.TXT", any_case=True)
    count = lambda d, name: d.groupBy(region.alias("region")).agg(F.count(F.lit(1)).cast("int").alias(name))
    return count(one, "found").join(count(two, "found_any_case"), "region").join(count(files.newest(one, 1000), "newest"), "region")


@query(f"WITH {SQL_LINES} SELECT lower(label) AS family, count(*) AS n FROM got GROUP BY ALL")
def lexicon_round_trip(spark, sf_dir):
    path = scratch_path(spark, "lexicon")
    lexicon.save({"families": lexicon.family_counts(_parsed(spark, sf_dir))}, path)
    return lexicon.load(spark, path)["families"]


def _parsed(spark, sf_dir):
    from calipra.plans.catalog import parsed

    return parsed(spark, sf_dir)


@query(f"WITH {SQL_LINES} SELECT file_name, text, false AS old FROM got WHERE pos = 1 UNION ALL SELECT file_name, text, true FROM got WHERE pos = 2")
def upserted_labels(spark, sf_dir):
    d = lines(spark, sf_dir)
    key = F.concat_ws("#", "file_name", "pos").alias("file_path")
    old = d.filter("pos <= 2").select(key, "file_name", F.when(F.col("pos") == 1, "stale").otherwise(F.col("text")).alias("text"), F.lit(1).alias("version"))
    new = d.filter("pos = 1").select(key, "file_name", "text", F.lit(2).alias("version"))
    return records.upsert(old, new).select("file_name", "text", (F.col("version") == 1).alias("old"))


#: Lines whose spacing readers got wrong, and the lines that are made of them.
SPACED = (
    ("LVOTVmax 1.2 m / s", "LVOT Vmax 1.2 m/s"),
    ("AV max PG 3 mm Hg", "AV maxPG 3 mmHg"),
)


@query(f"WITH {_values(SPACED, 'text', 'line')} SELECT c_custkey, line FROM customer JOIN cases ON c_custkey % {len(SPACED)} = k")
def spacing_repairs(spark, sf_dir):
    return _cases(spark, sf_dir, [c[0] for c in SPACED]).select("c_custkey", F.explode(repaired_lines(F.col("text"))).alias("line"))

"""Queries whose lines hold what readers of images get wrong, and of records, paths, settings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from calipra.functions.parse import structured, with_parsed
from calipra.functions.text import canonical_label_line, flatten_error, is_number, measurement_stem, safe_name
from calipra.operators import candidates, configs, registry, results, summaries
from calipra.plans.catalog import query
from calipra.plans.fixtures import SQL_LINES, lines, read
from calipra.sources import files, records, reports

#: Lines as read, and what is to be made of them: canonical line, prefix, label, value, unit, and whether it is a measurement.
CASES = (
    ("AVS 2.1 cm2", "AVA 2.1 cm2", None, "AVA", "2.1", "cm2", True),
    ("LYIDd 4.5 cm", "LVIDd 4.5 cm", None, "LVIDd", "4.5", "cm", True),
    ("2 LVYIDS 3.1 em", "2 LVIDs 3.1 cm", "2", "LVIDs", "3.1", "cm", True),
    ("LVPVWd 1.0 cm", "LVPWd 1.0 cm", None, "LVPWd", "1.0", "cm", True),
    ("1IVSd 1.0 cm", "1 IVSd 1.0 cm", "1", "IVSd", "1.0", "cm", True),
    ("IYSd 0,9cm", "IVSd 0,9 cm", None, "IVSd", "0.9", "cm", True),
    ("\\text{LVOT} Vmax 1.2 \\mathrm{m/s}", "LVOT Vmax 1.2 m/s", None, "LVOT Vmax", "1.2", "m/s", True),
    ("3 E’ Lat 9 cm/s", "3 E' Lat 9 cm/s", "3", "E' Lat", "9", "cm/s", True),
    ("MV Dect 180 ms", "MV DecT 180 ms", None, "MV DecT", "180", "ms", True),
    ("55 %", "55 %", None, "55 %", "55", "%", True),
    ("EF(Teich) 60%", "EF (Teich) 60 %", None, "EF (Teich)", "60", "%", True),
    ("l LVIDd 4 cm", "1 LVIDd 4 cm", "1", "LVIDd", "4", "cm", True),
    ("AV Vmax 1.7 m/s ____", "AV Vmax 1.7 m/s", None, "AV Vmax", "1.7", "m/s", True),
    ("AV maxPG 12 mmHg .....", "AV maxPG 12 mmHg", None, "AV maxPG", "12", "mmHg", True),
    ("日本語", "", None, None, None, None, False),
    ("P Vein s 0.5 m/s", "P Vein s 0.5 m/s", None, "P Vein s", "0.5", "m/s", True),
    ("EF A4C 62 %", "EF A4C 62 %", None, "EF A4C", "62", "%", True),
    ("LYOT Diam 2.0 mis", "LVOT Diam 2.0 m/s", None, "LVOT Diam", "2.0", "m/s", True),
    ("Ao Diam", "Ao Diam", None, "Ao Diam", None, None, False),
    ("PRand PG | 4.1  mhg", "PRend PG 4.1 mmHg", None, "PRend PG", "4.1", "mmHg", True),
    (" ... ", "", None, None, None, None, False),
    ("HR 71 bpm", "HR 71 bpm", None, "HR", "71", "bpm", True),
    ("AV Vmean -0.4 m/s", "AV Vmean -0.4 m/s", None, "AV Vmean", "-0.4", "m/s", True),
    ("", "", None, None, None, None, False),
)


def _quoted(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows, *names: str) -> str:
    """A WITH clause cases of rows, numbered from 0 as k."""
    return f"cases AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, (i, *r))) + ')' for i, r in enumerate(rows))}) AS c(k, {', '.join(names)}))"


def _cases(spark, sf_dir, texts: list):
    """Each customer with one of the texts, in turn; the texts are a table of a few rows."""
    few = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(texts)).cast("int").alias("k"))
    return c.join(F.broadcast(few), "k")


@query(f"WITH {_values(CASES, 'text', 'canonical', 'prefix', 'label', 'value', 'unit', 'measured')} SELECT c_custkey, text, canonical, prefix, label, value, unit, measured FROM customer JOIN cases ON c_custkey % {len(CASES)} = k")
def decoder_cases(spark, sf_dir):
    d = with_parsed(_cases(spark, sf_dir, [c[0] for c in CASES]))
    return d.select("c_custkey", "text", "canonical", *[F.col(f"parsed.{c}") for c in ("prefix", "label", "value", "unit")], F.col("parsed.is_measurement").alias("measured"))


#: Texts, one token or more, and what is wrong with each as a reading: junk, a value alone, a layout out of order, wanting more views.
READINGS = (
    ("AV Vmax 1.7 m/s", 4, False, False, False, False),
    ("1.7 m/s", 1, False, True, True, True),
    ("", 0, True, False, False, True),
    ("AV Vmax 1.7 qq", 4, True, False, False, False),
    ("Ao", 1, True, False, False, True),
    ("Ascending Ao", 2, False, False, False, False),
    ("4.1 cm AV Vmax", 1, False, False, True, True),
)


@query(f"WITH {_values(READINGS, 'text', 'n', 'junk', 'alone', 'malformed', 'more')} SELECT c_custkey, text, junk, alone, malformed, more FROM customer JOIN cases ON c_custkey % {len(READINGS)} = k")
def flags_of_readings(spark, sf_dir):
    n = F.element_at(F.array(*[F.lit(r[1]) for r in READINGS]), F.col("k") + 1)
    d = with_parsed(_cases(spark, sf_dir, [r[0] for r in READINGS])).withColumn("n", n)
    c, p = F.col("canonical"), F.col("parsed")
    more = candidates.wants_more_views(F.col("text"), F.col("n"), F.lit(False))
    return d.select("c_custkey", "text", candidates.is_junk(c, p).alias("junk"), candidates.is_value_only(p, F.col("n")).alias("alone"), candidates.is_malformed(c, p, F.col("n")).alias("malformed"), more.alias("more"))


@query(f"""WITH {SQL_LINES}
SELECT file_name, pos, CASE corruption WHEN 0 THEN 'fallback_disagreement' WHEN 1 THEN 'low_quality' WHEN 3 THEN 'char_count_mismatch' ELSE 'none' END AS reason,
  CASE WHEN corruption = 4 THEN 'error' WHEN corruption IN (5, 6) THEN CASE WHEN corruption = 5 THEN 'review_retry_improved' ELSE 'accepted' END WHEN corruption IN (3, 7) THEN 'review_required' ELSE 'accepted' END AS review FROM got""")
def reasons_and_reviews(spark, sf_dir):
    c = F.col("corruption")
    d = with_parsed(lines(spark, sf_dir))
    reason = candidates.trigger_reason(c == 0, F.when(c == 1, 0.5).otherwise(0.9), F.col("text"), F.col("canonical"), F.col("parsed"), F.lit(3), c != 3)
    review = candidates.review_status(F.when(c == 4, " ").otherwise(F.col("text")), c.isin(5, 6), c == 7, c != 3, F.when(c == 5, 0.1).otherwise(0.8))
    return d.select("file_name", "pos", reason.alias("reason"), review.alias("review"))


# names, values and units of measurements

NAMES = (
    (" AV_vmax ", "1,7", "m/s;", "AV Vmax", "1.7", "m/s"),
    ("LVOT vti", "20", "cm", "LVOT VTI", "20", "cm"),
    ("mv / E", "0.8", "MIS", "mv/E", "0.8", "m/s"),
    ("AV maxpg", "12.5", None, "AV maxPG", "12.5", "mmHg"),
    ("MV vmax", "80", "ms", "MV Vmax", "80", "m/s"),
    ("lvidd", "4.1", "cm", "LVIDD", "4.1", "cm"),
    ("Frame Rate", "50", "Hz", None, None, None),
    ("LVOT diam", "abc", "cm", None, None, None),
    ("12", "1", "cm", None, None, None),
)


@query(f"WITH {_values(NAMES, 'a', 'b', 'c', 'name', 'value', 'unit')} SELECT c_custkey, name, value, unit FROM customer JOIN cases ON c_custkey % {len(NAMES)} = k WHERE name IS NOT NULL")
def clean_names(spark, sf_dir):
    few = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(NAMES)], "k int, name string, value string, unit string")
    d = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(NAMES)).cast("int").alias("k")).join(F.broadcast(few), "k")
    return results.clean_measurements(d).select("c_custkey", "name", "value", "unit")


@query(f"""WITH {SQL_LINES}, m AS (SELECT file_name, pos, 'AV Vmax' AS name, CAST(pos % 2 AS VARCHAR) AS value, CASE WHEN pos % 3 = 0 THEN 'm/s' END AS unit FROM got),
b AS (SELECT *, coalesce(unit, 'm/s') AS u FROM m)
SELECT file_name, name, value, u AS unit, min(pos) AS first_pos FROM b GROUP BY ALL""")
def postprocessed(spark, sf_dir):
    d = lines(spark, sf_dir).select("file_name", "pos", F.when(F.col("pos") % 4 == 1, "AV  vmax").otherwise("AV Vmax").alias("name"), (F.col("pos") % 2).cast("string").alias("value"), F.when(F.col("pos") % 3 == 0, "m/s").alias("unit"))
    return results.postprocess(d, "file_name").select("file_name", "name", "value", "unit", "first_pos")


@query(f"WITH {SQL_LINES} SELECT file_name, lower(engine_name) AS name, min(pos) AS pos FROM got GROUP BY ALL")
def first_of_equals(spark, sf_dir):
    d = lines(spark, sf_dir).select("file_name", "pos", F.when(F.col("pos") % 2 == 0, F.lower("engine_name")).otherwise(F.col("engine_name")).alias("name"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("unit"))
    return results.first_distinct(d, "file_name").select("file_name", F.lower("name").alias("name"), "pos")


LABELLED = (
    ("LVOT  Vmax 1.2m/s", "LVOT Vmax 1.2 m/s", "LVOT Vmax 1.2 m/s", "LVOT Vmax 1.2 m/s", None, "LVOT Vmax", "1.2", "m/s"),
    ("\\text{EF} 60\\%", "EF 60 %", "EF 60 %", "EF 60 %", None, "EF", "60", "%"),
    ("2 PHT 50 m/s 2", "2 PHT 50 m/s2", "2 PHT 50 m/s 2", "2 PHT 50 m/s 2", "2", "PHT", "50", "m/s2"),
    ("AV area 2CM", "AV area 2CM", "AV area 2CM", "AV area 2 CM", None, "AV area", "2", "cm"),
    ("Ao Diam", "Ao Diam", "Ao Diam", "Ao Diam", None, "Ao Diam", None, None),
)


@query(f"WITH {_values(LABELLED, 'text', 'labelled', 'third', 'viewed', 'prefix', 'label', 'value', 'unit')} SELECT c_custkey, labelled, third, viewed, prefix, label, value, unit FROM customer JOIN cases ON c_custkey % {len(LABELLED)} = k")
def labelled_lines(spark, sf_dir):
    d = _cases(spark, sf_dir, [r[0] for r in LABELLED]).withColumn("labelled", canonical_label_line(F.col("text")))
    t = F.col("text")
    d = d.withColumn("s", structured(F.col("labelled")))
    return d.select("c_custkey", "labelled", canonical_label_line(t, fix_squares=False).alias("third"), canonical_label_line(t, True, False).alias("viewed"), "s.prefix", "s.label", "s.value", "s.unit")


@query(f"""WITH {SQL_LINES}
SELECT file_name, pos, CASE WHEN pos % 4 = 0 THEN false WHEN pos % 4 = 1 THEN true ELSE pos % 4 = 2 END AS number, array_to_string(string_split(label, ' ')[1:3], ' ') AS stem, regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g') AS safe,
  CASE WHEN corruption = 0 THEN 'ValueError: ' || engine_name WHEN corruption = 1 THEN engine_name WHEN corruption = 2 THEN 'ValueError' ELSE '' END AS error FROM got""")
def keys_of_texts(spark, sf_dir):
    k, c = F.col("pos") % 4, F.col("corruption")
    value = F.when(k == 0, F.concat("value", F.lit("."))).when(k == 1, F.concat(F.lit("-"), "value")).when(k == 2, F.floor(F.col("value").cast("double")).cast("string")).otherwise(F.concat(F.lit("."), "value"))
    kind, said = F.when(c.isin(0, 2), "ValueError").otherwise(""), F.when(c.isin(0, 1), F.col("engine_name"))
    return lines(spark, sf_dir).select("file_name", "pos", is_number(value).alias("number"), measurement_stem(F.concat_ws("  ", "prefix", "label")).alias("stem"), safe_name(F.col("text")).alias("safe"), flatten_error(kind, said).alias("error"))


# files and paths


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def restricted_files(spark, sf_dir):
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    everything = o.select(F.col("o_orderkey").alias("path"))
    return files.restrict(everything, o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("path")), l.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("path")))


@query("SELECT o_orderkey AS k, 'p' || o_custkey AS patient, 'e' || o_orderkey AS exam, CASE WHEN o_orderkey % 2 = 0 THEN '/data/us/p' || o_custkey ELSE '/mnt/p' || o_custkey END || '/e' || o_orderkey || '/f.dcm' AS moved FROM orders")
def moved_paths(spark, sf_dir):
    tail = F.concat(F.lit("\\p"), F.col("o_custkey").cast("string"), F.lit("\\e"), F.col("o_orderkey").cast("string"), F.lit("\\f.dcm"))
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "D:\\home\\us").otherwise("c:\\home"), tail)
    d = read(spark, sf_dir, "orders").withColumn("path", path)
    ids = files.path_ids(F.col("path"))
    return d.select(F.col("o_orderkey").alias("k"), ids["patient"].alias("patient"), ids["exam"].alias("exam"), files.reroot(F.col("path"), {"/home/": "/mnt/", "/home/us/": "/data/us/"}).alias("moved"))


@query("""WITH f AS (SELECT o_orderkey AS k, o_custkey AS c, 'n' || (o_orderkey % 50) AS name FROM orders),
l AS (SELECT '/old/c' || c || '/' || name || '.dcm' AS label_path, c, name FROM f WHERE k % 7 = 0 UNION SELECT '/old/none.dcm', -1, 'none'),
d AS (SELECT DISTINCT '/new/c' || c || '/' || name || '.dcm' AS file_path, c, name FROM f WHERE k % 3 <> 0),
p AS (SELECT label_path, file_path, CASE WHEN l.c = d.c THEN 1 ELSE 0 END AS tail FROM l LEFT JOIN d ON l.name = d.name)
SELECT label_path, file_path FROM (SELECT *, row_number() OVER (PARTITION BY label_path ORDER BY tail DESC, file_path) AS r FROM p) WHERE r = 1""")
def files_of_labels(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    tail = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/n"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".dcm"))
    labels = o.filter("o_orderkey % 7 = 0").select(F.concat(F.lit("/old/"), tail).alias("path")).union(spark.createDataFrame([("/old/none.dcm",)], "path string"))
    return files.match_labels(labels, o.filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("/new/"), tail).alias("path")))


@query("""WITH f AS (SELECT 's' || o_custkey AS study_uid, o_orderkey AS path FROM orders WHERE o_custkey % 4 <> 0)
SELECT a.study_uid, a.path, b.path AS companion FROM f a JOIN f b ON a.study_uid = b.study_uid AND a.path <> b.path""")
def companions_of_files(spark, sf_dir):
    uid = F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).when(F.col("o_custkey") % 8 == 0, "")
    return reports.companions(read(spark, sf_dir, "orders").select(uid.alias("study_uid"), F.col("o_orderkey").alias("path")))


@query("SELECT min(event_id) AS pos, event_type AS path FROM events GROUP BY event_type")
def queue_for_review(spark, sf_dir):
    return summaries.review_queue(read(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("pos")))


# records


@query(f"""WITH {SQL_LINES}
SELECT file_name, 'error' AS kind, 'OSError: ' || max(engine_name) AS detail FROM got GROUP BY file_name HAVING max(corruption) = 9
UNION ALL SELECT file_name, 'flag', label || ' ' || value || ' a,b' FROM got WHERE corruption = 1 UNION ALL SELECT file_name, 'manual', text FROM got WHERE corruption = 2""")
def issues_of_items(spark, sf_dir):
    c = F.col("corruption")
    m = F.struct(F.col("label").alias("name"), "value", F.when(c == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    l = F.struct("text", (c == 2).alias("manual_verify_required"))
    d = lines(spark, sf_dir).groupBy(F.col("file_name").alias("path")).agg(F.collect_list(m).alias("measurements"), F.collect_list(l).alias("lines"), F.when(F.max(c) == 9, F.struct(F.lit("OSError").alias("type"), F.max("engine_name").alias("message"))).alias("error"))
    return summaries.issues(d).withColumnRenamed("path", "file_name")


@query(f"WITH {SQL_LINES} SELECT file_name, text FROM got WHERE split = 'validation' AND corruption < 3")
def mismatched_lines(spark, sf_dir):
    return summaries.mismatches(lines(spark, sf_dir).withColumn("line_match", F.col("corruption") >= 3), "file_name", "text", split="validation")


@query(f"WITH {SQL_LINES}, c AS (SELECT file_name, count(*) AS expected, count(*) FILTER (corruption > 0) AS exact FROM got GROUP BY file_name) SELECT * FROM c WHERE exact < expected ORDER BY file_name LIMIT 50")
def first_hard_cases(spark, sf_dir):
    return summaries.hard_cases(lines(spark, sf_dir).withColumn("line_match", F.col("corruption") > 0), 50)


@query(f"""WITH {SQL_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY pos) AS i FROM got)
SELECT file_name, CAST(CASE WHEN pos % 2 = 0 THEN pos * 10 ELSE i END AS INTEGER) AS line_order, text FROM r WHERE corruption <> 1""")
def numbered_lines(spark, sf_dir):
    l = F.struct("pos", F.struct(F.when(F.col("pos") % 2 == 0, F.col("pos") * 10).alias("order"), F.when(F.col("corruption") == 1, " ").otherwise(F.concat("text", F.lit(" "))).alias("text")).alias("l"))
    d = lines(spark, sf_dir).groupBy("file_name").agg(F.sort_array(F.collect_list(l)).alias("l"))
    return d.select("file_name", F.explode(records.normal_lines(F.transform("l", lambda x: x["l"]))).alias("x")).select("file_name", F.col("x.order").alias("line_order"), "x.text")


@query(f"""WITH {SQL_LINES}
SELECT engine_name, count(*) FILTER (corruption < 2) AS uncertain_lines, count(*) FILTER (corruption < 4) AS fallback_invocations, count(*) FILTER (corruption IN (0, 2)) AS fallback_accepts, count(*) FILTER (corruption IN (1, 3)) AS fallback_rejects, count(*) FILTER (corruption = 9) AS manual_lines FROM got GROUP BY ALL""")
def retries_of_engines(spark, sf_dir):
    c = F.col("corruption")
    return summaries.retry_summary(lines(spark, sf_dir).withColumns({"uncertain": c < 2, "fallback": c < 4, "accepted": c % 2 == 0, "manual": c == 9}), "engine_name")


REPLIES = (
    ('Here: [{"order": 2, "name": "AV Vmax", "value": "1.7", "unit": "m/s"}, 7, {"name": null}] done', "1|AV Vmax|1.7|m/s"),
    ('{"measurements": [{"name": "EF", "value": "60"}]}', "0|EF|60|-"),
    ("no rows", None),
)


@query(f"WITH {_values(REPLIES, 'text', 'row')} SELECT c_custkey, row FROM customer JOIN cases ON c_custkey % {len(REPLIES)} = k WHERE row IS NOT NULL")
def rows_of_replies(spark, sf_dir):
    d = _cases(spark, sf_dir, [r[0] for r in REPLIES]).select("c_custkey", F.explode(records.reply_measurements(F.col("text"))).alias("r"))
    return d.select("c_custkey", F.concat_ws("|", F.col("r.order_hint").cast("string"), *[F.coalesce(f"r.{c}", F.lit("-")) for c in ("name", "value", "unit")]).alias("row"))


@query("SELECT l_orderkey AS path, l_linenumber AS line, CASE WHEN l_linenumber % 3 = 0 THEN 25.0 WHEN l_linenumber % 3 = 1 THEN 40.0 ELSE 30.0 END::DOUBLE AS fps, CASE WHEN l_linenumber % 3 = 2 THEN round(1000 / 30.0, 6) WHEN l_linenumber % 3 = 0 THEN 40.0 ELSE 25.0 END::DOUBLE AS frame_time_ms, CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_partkey AS INTEGER) ELSE 1 END AS n_frames FROM lineitem WHERE l_partkey > 0")
def header_fields(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    header = F.map_from_arrays(F.array(F.lit("RecommendedDisplayFrameRate"), F.lit("FrameTime"), F.lit("NumberOfFrames")), F.array(F.when(k == 0, "25").otherwise("0"), F.when(k == 1, "25.0").otherwise("x"), F.when(k == 1, F.col("l_partkey").cast("string")).otherwise("-2")))
    d = read(spark, sf_dir, "lineitem").filter("l_partkey > 0").withColumn("h", header)
    t = summaries.frame_timing(F.col("h"))
    return d.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), t["fps"].alias("fps"), F.round(t["frame_time_ms"], 6).alias("frame_time_ms"), summaries.frame_count(F.col("h")).alias("n_frames"))


@query("""WITH b AS (SELECT l_orderkey AS path, list(l_linenumber * 20) AS x FROM lineitem GROUP BY ALL),
o AS (SELECT path, list_sum([greatest(v + v / 2 - 100, 0) FOR v IN x]) AS as_size, list_sum([greatest(v / 2 - 100, 0) + greatest(v - v / 2, 0) FOR v IN x]) AS as_ends FROM b)
SELECT path, CASE WHEN as_size <= as_ends THEN 'xywh' ELSE 'xyxy' END AS format FROM o""")
def formats_of_boxes(spark, sf_dir):
    x = F.col("l_linenumber").cast("double") * 20
    d = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_list(F.array(x, F.lit(0.0), x / 2, F.lit(10.0))).alias("b"))
    return d.select("path", summaries.infer_box_format(F.col("b"), F.lit(100.0), F.lit(100.0)).alias("format"))


@query("SELECT l_orderkey AS path, l_linenumber AS line, CASE WHEN l_partkey % 5 = 3 THEN 'current' WHEN l_suppkey % 5 = 3 THEN 'vertical' WHEN l_linenumber = 3 THEN 'blob' ELSE 'current' END AS policy FROM lineitem")
def policies_of_counts(spark, sf_dir):
    p = summaries.count_policy(F.lit(3), (F.col("l_suppkey") % 5).cast("int"), F.col("l_linenumber").cast("int"), (F.col("l_partkey") % 5).cast("int"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), p.alias("policy"))


# engines and settings


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'a' WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS engine, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'ok' ELSE 'error' END AS status FROM orders")
def first_engine(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    run = lambda k: o.withColumn("status", F.when(F.col("path") % k == 0, "ok").otherwise("error"))
    return registry.first_success({"a": run(2), "b": run(3)}).select("path", "engine", "status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS scale_factor, CASE WHEN c_custkey % 3 = 0 THEN 'otsu' ELSE 'none' END AS threshold_mode, 'lanczos' AS scale_algo, c_custkey % 2 = 0 AS unsharp FROM customer")
def settings_of_runs(spark, sf_dir):
    spec = F.concat(F.lit('{"no such key": 1'), F.when(F.col("c_custkey") % 2 == 0, ', "scale_factor": 3, "unsharp": true').otherwise(""), F.when(F.col("c_custkey") % 3 == 0, ', "threshold_mode": "otsu"').otherwise(""), F.lit("}"))
    return configs.with_defaults(read(spark, sf_dir, "customer").select("c_custkey", spec.alias("spec"))).select("c_custkey", "scale_factor", "threshold_mode", "scale_algo", "unsharp")


@query("SELECT n_nationkey AS file, name FROM nation, (SELECT unnest(['plan_no_binarize_1x', 'plan_no_binarize_3x_cubic', 'plan_scale_then_otsu_1x', 'plan_scale_then_otsu_3x_cubic', 'plan_scale_then_otsu_3x_lanczos', 'plan_otsu_then_scale_3x_cubic', 'plan_otsu_then_scale_3x_lanczos']) AS name)")
def runs_of_configs(spark, sf_dir):
    some = configs.select_configs(configs.plan_configs(spark), exclude=["plan_no_binarize_3x_lanczos"])
    return configs.runs(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file")), some).select("file", "name")


CODES = (("mm[Hg]", "mmHg"), (" Centimeter ", "cm"), ("1", None), ("{H.B}/min", "bpm"), ("kPa", "kPa"), (" ", None))


@query(f"WITH {_values(CODES, 'code', 'unit')} SELECT c_custkey, unit FROM customer JOIN cases ON c_custkey % {len(CODES)} = k")
def units_of_reports(spark, sf_dir):
    return _cases(spark, sf_dir, [c[0] for c in CODES]).select("c_custkey", reports.report_unit(F.col("text")).alias("unit"))


@query(f"""WITH {SQL_LINES}, n AS (SELECT file_name, bool_or(corruption = 0) AS has FROM got GROUP BY file_name)
SELECT file_name AS path, label AS name, value, unit, 0.995::DOUBLE AS confidence FROM got WHERE corruption = 0
UNION ALL SELECT file_name, concat_ws(' ', prefix, label), value, unit, 0.94 FROM got JOIN n USING (file_name) WHERE NOT has AND corruption > 5""")
def measurements_of_reports(spark, sf_dir):
    c = F.col("corruption")
    item = F.struct(F.when(c == 0, "num").when(c > 5, "TEXT").otherwise("CODE").alias("value_type"), F.when(c == 0, F.concat(F.lit(" "), "label")).otherwise(F.concat_ws(" ", "prefix", "label")).alias("concept"), "value", "unit")
    kind = F.struct(item["value_type"].alias("value_type"), item["concept"].alias("concept"), F.col("value").alias("numeric_value"), F.col("unit").alias("unit_code"), F.concat_ws(" ", "value", "unit").alias("text"), F.lit(None).cast("string").alias("children"))
    d = lines(spark, sf_dir).groupBy(F.col("file_name").alias("path")).agg(F.to_json(F.array_sort(F.collect_list(kind))).alias("inner"))
    tree = d.select("path", F.concat(F.lit('[{"value_type":"CONTAINER","children":'), F.col("inner"), F.lit("}]")).alias("content"))
    return reports.measurements(reports.walk(tree)).drop("order_path")

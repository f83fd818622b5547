"""Operators whose other ways, limits and errors no query reaches."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from calipra.functions.parse import with_parsed
from calipra.operators import assembly, evaluate, lexicon, pixels, rerank, results
from calipra.sources import files, records


def test_percentiles_are_exact(spark):
    rows = [("a", float(v)) for v in (5, 1, 9, 9, 9, 2, 7)] + [("b", 3.0)] * 40 + [("c", 1e9), ("c", -1e9), ("c", 0.1), ("d", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: r.p for r in d.filter("v is not null").groupBy("g").agg(F.percentile("v", 0.95).alias("p")).collect()}
    got = {r.g: r.percentile for r in results.exact_percentile(d, "v", 0.95, "g", bins=4, rounds=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-6 for g in want)


@pytest.fixture(scope="module")
def panels(spark):
    """A lexicon of some families, and panels with a typo, an unknown family and an odd unit."""
    known = [(f"f{i}", "train", p, t) for i in range(6) for p, t in enumerate(("1 AV Vmax 1.7 m/s", "2 AV maxPG 12 mmHg", "LVOT Diam 2.0 cm"), 1)]
    lex = rerank.build(with_parsed(spark.createDataFrame(known, "file_name string, split string, pos int, text string")))
    read = [("p", 0, 0, "1 AV Vmaxx 1.7 m/s", 0.9), ("p", 1, 0, "2 AV maxPG 12 cm", 0.9), ("p", 2, 0, "LVOT Diam 2.0 cm", 0.9), ("p", 2, 1, "Qrst 5 cm", 0.95)]
    c = spark.createDataFrame(read, "panel_id string, line_order int, cand_pos int, text string, confidence double").withColumn("source", F.lit("primary"))
    return lex, with_parsed(c)


def test_repairs_join_the_candidates(panels):
    lex, c = panels
    got = {(r.line_order, r.canonical): r.source for r in rerank.augment(c, lex).collect()}
    assert got[0, "1 AV Vmax 1.7 m/s"] == "primary_lexicon_repair" and got[1, "2 AV maxPG 12 mmHg"] == "primary_family_repair"
    assert len(got) == 6 and (2, "Qrst 5 cm") in got
    alike = {r.canonical: r.family_similarity for r in rerank.with_similarity(c, lex).collect()}
    assert alike["LVOT Diam 2.0 cm"] is None and 0.9 < alike["1 AV Vmaxx 1.7 m/s"] < 1 and alike["Qrst 5 cm"] < 0.5


def test_equal_lines_are_repaired_once(spark, panels, monkeypatch):
    lex, c = panels
    names, written = [], rerank.written
    monkeypatch.setattr(rerank, "written", lambda d, name: names.append((name, w := written(d, name))) or w)
    many = c.unionByName(c.withColumn("panel_id", F.lit("q"))).unionByName(c.withColumn("panel_id", F.lit(None).cast("string")))
    got = rerank.repairs(many, lex)
    assert sorted(map(tuple, got.select("line_order", "text", "source").collect())) == sorted(3 * [(0, "1 AV Vmax 1.7 m/s", "primary_lexicon_repair"), (1, "2 AV maxPG 12 mmHg", "primary_family_repair")])
    assert {r.parsed.family for r in got.collect()} == {"av vmax", "av maxpg"} and got.columns == c.columns
    made = {name: d.count() for name, d in names}
    assert made["lexicon_repair"] == made["family_repair"] == 1


def test_panels_choose_alike_with_and_without_a_broadcast(panels):
    lex, c = panels
    scored = rerank.score(rerank.with_similarity(rerank.augment(c, lex), lex), lex)
    one = sorted(map(tuple, rerank.rerank_panels(scored, lex["transitions"]).collect()))
    two = sorted(map(tuple, rerank.rerank_panels(scored, lex["transitions"], limit=0).collect()))
    assert one == two and [r[2] for r in one] == ["1 AV Vmax 1.7 m/s", "2 AV maxPG 12 mmHg", "LVOT Diam 2.0 cm"]


def test_lexicon_saved_and_loaded(spark, panels, tmp_path):
    lexicon.save({"units": panels[0]["units"]}, f"file://{tmp_path}/lex")
    assert sorted(map(tuple, lexicon.load(spark, f"file://{tmp_path}/lex")["units"].collect())) == sorted(map(tuple, panels[0]["units"].collect()))


def test_a_cached_lexicon_is_loaded_again_when_it_changes(spark, panels, tmp_path):
    path = f"file://{tmp_path}/lex"
    lexicon.save({"units": panels[0]["units"]}, path)
    cached = lexicon.Cached(spark, path)
    first = cached.get()
    assert cached.get() is first and set(first) == {"units"}
    lexicon.save({"families": panels[0]["families"]}, path)
    assert set(cached.get()) == {"families", "units"}


def test_boxes_in_rows():
    boxes = [(50, 1, 5, 8), (0, 0, 10, 10), (0, 30, 10, 10), (20, 12, 5, 4), (0, 5, 0, 3)]
    assert pixels.rows_of_boxes(boxes) == [[(0, 0, 10, 10), (50, 1, 5, 8)], [(20, 12, 5, 4)], [(0, 30, 10, 10)]]
    assert pixels.rows_of_boxes(boxes, by_centre=False) == [[(0, 0, 10, 10), (50, 1, 5, 8), (20, 12, 5, 4)], [(0, 30, 10, 10)]]
    assert pixels.rows_of_boxes([]) == []


def test_label_files_are_small(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(records, "MAX_LABELS", 3)
    d = spark.range(4).select(F.lit("f").alias("file_name"), F.lit("p").alias("file_path"), F.lit("train").alias("split"), F.col("id").alias("pos"), F.lit("x").alias("text"))
    with pytest.raises(ValueError, match="label file"):
        records.write_labels(d, f"file://{tmp_path}/labels")


def test_many_labels_are_several_label_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(records, "MAX_LABELS", 30)
    path, k = f"file://{tmp_path}/labels", F.col("id").cast("string")
    d = spark.range(200).select(F.concat(F.lit("f"), k).alias("file_name"), F.concat(F.lit("/d/"), k).alias("file_path"), F.lit("train").alias("split"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("pos"), k.alias("text"))
    records.write_labels(d, path)
    got = records.read_labels(spark, path, strict_order=True).select("file_name", "file_path", "pos", "line_order", "text").collect()
    assert sorted(map(tuple, got)) == sorted((f"f{i}", f"/d/{i}", pos, pos, str(i)) for i in range(200) for pos in (1, 2))
    assert len(list((tmp_path / "labels").glob("*.json"))) > 5


def test_many_scores_are_several_score_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(records, "SCORES_A_FILE", 20)
    path, k = f"file://{tmp_path}/scores", F.col("id").cast("string")
    match = F.struct(k.alias("expected_text"), k.alias("predicted_text"), F.lit(True).alias("full_match"), F.lit(True).alias("line_match"))
    records.write_scores(spark.range(200).select(F.concat(F.lit("f"), k).alias("file_name"), F.lit("train").alias("split"), F.array(match, match).alias("matches")), path)
    got = records.read_scores(spark, path).select("file_name", "line_index", "expected_text").collect()
    assert sorted(map(tuple, got)) == sorted((f"f{i}", at, str(i)) for i in range(200) for at in (0, 1))
    assert len(list((tmp_path / "scores").glob("*.json"))) > 10
    assert len({p.name.split("-")[1] for p in (tmp_path / "scores").glob("*.json")}) > 8  # tasks: records aren't gathered by few of them


def _differs(spark, folder, name, lines, parts):
    """Rows of a query and of its SQL over lineitem (order, part, supplier, line, quantity, tax, flag) and part (key, name, size), if they differ."""
    one = [(o, p, s, n, float(q), 1.0, 0.0, t, f, "O", datetime(2000, 1, 1)) for o, p, s, n, q, t, f in lines]
    spark.createDataFrame(one, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(f"file://{folder}/lineitem.parquet")
    spark.createDataFrame([(k, n, "LARGE", s) for k, n, s in parts], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"file://{folder}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, f"file://{folder}").select(*want.columns).collect()
    got, want = sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)
    return None if got == want and want else (got, want)


def test_of_lines_with_one_place_a_region_has_the_first(spark, tmp_path):
    assert _differs(spark, tmp_path, "regions_of_files", [(1, 7, 1, 3, 5, t, "A") for t in (0.06, 0.01, 0.08)] + [(2, 7, 1, 3, 5, t, "N") for t in (0.01, 0.02)], [(7, "ring", 1)]) is None


def test_equal_lines_that_read_differently_stay_apart(spark, tmp_path):
    same = [(5, p, 1, n, 9, 0.0, "A") for p, n in ((9, 1), (2, 2), (7, 3))]
    assert _differs(spark, tmp_path, "union_of_scores", same, [(9, "bolt", 3), (2, "ring", 3), (7, "ring", 3)]) is None


def test_changes_are_of_sets(spark):
    table = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    got = evaluate.rollout_diff(table("a", "a", "b", None, None), table("a", "c", "c", None), "k").collect()
    assert sorted(map(tuple, got), key=repr) == [("b", "corrected"), ("c", "regressed")]


def test_the_longest_tail_needs_no_pairs(spark):
    labels = [f"/old/c{i}/n.dcm" for i in range(20)] + ["/old/c1/m.dcm", "x\\c2\\n.dcm", "n.dcm", "/dcm", "", "none", None, "/new/c3/n.dcm"]
    paths = [f"/new/c{i}/n.dcm" for i in range(0, 20, 2)] + ["/new/c3/n.dcm", "D:\\c4\\n.dcm", "a/", None]
    table = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    parts = lambda p: p.replace("\\", "/").split("/")[::-1]
    tail = lambda a, b: next((i for i, (x, y) in enumerate(zip(parts(a), parts(b), strict=False)) if x != y), min(len(parts(a)), len(parts(b))))
    want = {p: min((q for q in paths if p is not None and q is not None and tail(p, q)), key=lambda q: (-tail(p, q), q), default=None) for p in labels}
    made = files.match_labels(table(labels), table(paths))
    assert {r.label_path: r.file_path for r in made.collect()} == want and made.count() == len(want)


def test_frame_limits_and_slices(spark):
    d = spark.createDataFrame([(i,) for i in range(5)], "frame_index int")
    assert assembly.first_frames(d, None, None, 2).count() == 2 and assembly.first_frames(d, 0, 3).count() == 5
    one = spark.range(1).select(assembly.slice_text(F.array(F.lit("A"), F.lit(""), F.lit("b\n"), F.lit(" ")), F.array(F.lit(True), F.lit(True), F.lit(True))).alias("t"))
    assert one.first().t == "A b"


def test_lines_of_one_kind_are_scored_once_and_panels_choose_as_before(spark, panels, monkeypatch):
    """Panels whose lines repeat, by kinds and without; small places, so that panels are cut into several parts."""
    lex, c = panels
    monkeypatch.setattr(rerank, "AT_ONCE", 5)
    many = c.select("*", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("k")).withColumn("panel_id", F.col("k")).filter("k <> 'c' or line_order <> 1")
    many = many.withColumn("confidence", F.col("confidence") - F.when(F.col("k") == "b", 0.3).otherwise(0.0)).drop("k")
    want = sorted(map(tuple, rerank.rerank_panels(rerank.score(rerank.with_similarity(rerank.augment(many, lex), lex), lex), lex["transitions"]).collect()))
    kinds = c.withColumn("panel_id", F.lit("any")).withColumn("kind", F.col("line_order")).withColumn("confidence", F.lit(1.0)).withColumn("loss", F.lit(0.0))
    scored = rerank.with_terms(rerank.with_similarity(rerank.augment(kinds, lex), lex), lex)
    own = many.groupBy("panel_id", "line_order").agg(F.transform(F.sort_array(F.collect_list(F.struct("cand_pos", "confidence"))), lambda x: x["confidence"]).alias("confidences")).withColumn("kind", F.col("line_order"))
    assert sorted(map(tuple, rerank.rerank_lines(own, scored, lex["transitions"], ["kind"]).collect())) == want and len(want) == 8
    assert sorted(map(tuple, rerank.rerank_lines(own, scored, lex["transitions"], ["kind"], limit=0).collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # batches cut panels
    try:
        assert sorted(map(tuple, rerank.rerank_lines(own, scored, lex["transitions"], ["kind"]).coalesce(1).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lexicon_of_weighted_lines(spark):
    rows = [("f", "train", 1, "1 AV Vmax 1.7 m/s"), ("f", "train", 1, "1 AV Vmax 1.7 m/s"), ("f", "train", 1, "1 AV Vmax 2.3 m/s"), ("f", "train", 2, "LVOT Diam 2.0 cm")]
    d = with_parsed(spark.createDataFrame(rows, "file_name string, split string, pos int, text string"))
    heavy = d.dropDuplicates(["text"]).withColumn("weight", F.when(F.col("text") == rows[0][3], 2).otherwise(1).cast("long"))
    one, two = rerank.build(d), rerank.build(heavy, d)
    for name in one:
        assert sorted(map(str, one[name].collect())) == sorted(map(str, two[name].collect())), name
    assert {r.family: r.n for r in two["stats"].collect()} == {"av vmax": 3, "lvot diam": 1}

"""Operators on small tables: lexicon, results, matching, reranking, recovery, sources and sinks, streams, configurations, pixels."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from calipra.functions.parse import with_parsed
from calipra.operators import candidates, configs, evaluate, lexicon, pixels, recover, registry, rerank, results
from calipra.sources import files, records, reports
from calipra.streaming import batch

LINES = [("a.dcm", "validation", 1, "1 IVSd 0.9 cm"), ("a.dcm", "validation", 2, "2 LVIDd 5.4 cm"), ("b.dcm", "train", 1, "1 IVSd 1.0 cm")]


@pytest.fixture(scope="module")
def labelled(spark):
    return with_parsed(spark.createDataFrame(LINES, "file_name string, split string, pos int, text string"))


def test_lexicon(labelled):
    assert {r.split: r.n for r in lexicon.split_counts(labelled).collect()} == {"validation": 2, "train": 1}
    ivsd = lexicon.value_stats(labelled).filter("family = 'ivsd'").first()
    assert (ivsd.n, ivsd.min_value, ivsd.max_value, ivsd.mean_value) == (2, 0.9, 1.0, 0.95)
    assert {(r.family, r.line_order, r.n) for r in lexicon.family_orders(labelled).collect()} == {("ivsd", "1", 2), ("lvidd", "2", 1)}
    assert [tuple(r) for r in lexicon.transitions(labelled).collect()] == [("ivsd", "lvidd", 1)]
    assert lexicon.exemplars(labelled).filter("family = 'ivsd'").first().exemplar == "1 IVSd 0.9 cm"
    assert lexicon.of_splits(labelled, " Train ").count() == 1 and lexicon.of_splits(labelled).count() == 3


def test_postprocess(spark):
    rows = [("f", 1, "avmaxpg", "12", None, 0.9), ("f", 2, "AV maxPG", "12", "mmHg", 0.8), ("f", 3, "Frame rate", "60", "hz", 0.9), ("f", 4, "LA", "x", "cm", 0.9), ("f", 5, "LA Diam", "4,1", None, 0.9), ("f", 6, "LADiam", "4.1", "cm", 0.7)]
    d = spark.createDataFrame(rows, "file string, pos int, name string, value string, unit string, confidence double")
    got = sorted((r.name, r.value, r.unit) for r in results.postprocess(d, "file").collect())
    assert got == [("AV maxPG", "12", "mmHg"), ("LA Diam", "4.1", "cm")]
    best = results.best_confidence(d.withColumn("name", F.lit("n")).withColumn("value", F.lit("1")).withColumn("unit", F.lit(None).cast("string")), "file").collect()
    assert [(r.pos, r.confidence) for r in best] == [(1, 0.9)]


def _item(line):
    words = line.split()
    return (line, None, words[0], words[1] if len(words) > 1 else None, words[2] if len(words) > 2 else None)


def _items(spark, rows):
    return spark.createDataFrame([(f, p, _item(t)) for f, p, t in rows], "file_name string, pos int, item struct<line:string,prefix:string,label:string,value:string,unit:string>")


def test_greedy_takes_each_prediction_once(spark):
    e = _items(spark, [("f", 1, "A 1 cm"), ("f", 2, "A 1 cm"), ("f", 3, "B 2 cm"), ("g", 1, "C 3 cm")])
    p = _items(spark, [("f", 1, "A 1 cm"), ("f", 2, "A 7 cm"), ("f", 3, "Z 9 mm")])
    got = {(r.file_name, r.pos): (r.predicted_text, r.line_match, r.label_match) for r in evaluate.greedy_matches(e, p).collect()}
    assert got == {("f", 1): ("A 1 cm", True, True), ("f", 2): ("A 7 cm", False, True), ("f", 3): (None, False, False), ("g", 1): (None, False, False)}
    exact = {(r.file_name, r.pos): r.predicted_text for r in evaluate.greedy_matches(e, p, "exact").collect()}
    assert exact["f", 3] == "Z 9 mm" and exact["g", 1] is None
    reuse = {(r.file_name, r.pos): (r.predicted_text, r.error_type) for r in evaluate.best_with_reuse(e, p).collect()}
    assert reuse["f", 2] == ("A 1 cm", "exact_match") and reuse["g", 1] == (None, "missing_prediction")


def test_rates_and_leaderboard(spark):
    m = spark.createDataFrame([("x", True, True, True, True, True), ("x", False, True, True, False, True)], "c string, line_match boolean, prefix_match boolean, label_match boolean, value_match boolean, unit_match boolean")
    r = evaluate.match_rates(m, "c").first()
    assert (r.n_lines, r.line_n, r.line_rate, r.value_rate) == (2, 1, 0.5, 0.5)
    s = spark.createDataFrame([("base", 0.5, 0.5, 9.0), ("fast", 0.7, 0.5, 1.0), ("slow", 0.7, 0.5, 2.0)], "config string, exact_rate double, value_rate double, elapsed double")
    assert [(x.config, x.rank, x.delta) for x in evaluate.leaderboard(s, "base").orderBy("rank").collect()] == [("fast", 1, 0.2), ("slow", 2, 0.2), ("base", 3, 0.0)]


def test_prefix_sums_over_ranges(spark):
    d = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("x"))
    got = results.prefix_sums(d.repartition(5), ["x"], "id", parts=7).orderBy("id").collect()
    assert [r.x_sum for r in got] == list(np.cumsum([i % 3 for i in range(1000)]))


def test_status_and_gate(spark):
    line = "struct<text:string,manual_verify_required:boolean,fallback_trigger_reason:string,line_ocr_count_matches:boolean,review_status:string>"
    rows = [([("x", False, "none", True, "accepted")], [("n", "1")], None), ([("x", True, "none", True, "accepted")], [], None), ([], [("n", "")], None), ([], [], "e"), ([], [], None)]
    d = spark.createDataFrame(rows, f"l array<{line}>, m array<struct<name:string,value:string>>, e string")
    assert [r[0] for r in d.select(results.batch_status(F.col("l"), F.col("m"), F.col("e"))).collect()] == [3, 2, 1, 1, 0]
    gate = lambda mode, n, m, u: spark.range(1).select(results.should_validate(F.lit(mode), F.lit(n), F.lit(m), F.lit(u), F.lit(0), F.lit(0))).first()[0]
    assert [gate("off", 1, 0, 9), gate("always", 1, 5, 0), gate("always", 0, 5, 0), gate("auto", 1, 0, 0), gate("auto", 1, 5, 1), gate("auto", 1, 5, 0), gate("odd", 1, 0, 9)] == [False, True, False, True, True, False, False]


def test_candidates(spark):
    rows = [("p", 1, 0, "1 IVSd 0.9 cm", 0.9, "primary"), ("p", 1, 1, "zz ## ..", 0.99, "fallback"), ("p", 1, 2, "IVSd 0.9 odd", 0.9, "primary")]
    d = with_parsed(spark.createDataFrame(rows, "panel_id string, line_order int, cand_pos int, text string, confidence double, source string"))
    d = d.withColumn("quality", candidates.quality(F.col("canonical"), F.col("parsed"), F.col("confidence")))
    assert {r.cand_pos for r in candidates.prune(d, "panel_id", "line_order").collect()} == {0}
    assert candidates.rank(d, "panel_id", "line_order").filter("rank = 1").first().cand_pos == 0
    assert [r[0] for r in d.orderBy("cand_pos").select(candidates.is_junk(F.col("canonical"), F.col("parsed"))).collect()] == [False, True, True]


def test_rerank_prefers_known_lines(spark, labelled):
    lex = rerank.build(labelled)
    rows = [("p", 0, 0, "1 lVSx 0.9 cm", 0.60, "primary"), ("p", 0, 1, "1 IVSd 0.9 cm", 0.55, "primary"), ("p", 1, 0, "2 LVIDd 5.4 cm", 0.9, "primary")]
    d = with_parsed(spark.createDataFrame(rows, "panel_id string, line_order int, cand_pos int, text string, confidence double, source string"))
    got = {r.line_order: r for r in rerank.rerank_panels(rerank.score(d, lex), lex["transitions"]).collect()}
    assert got[0].text == "1 IVSd 0.9 cm" and got[1].text == "2 LVIDd 5.4 cm" and got[0].confidence == 0.6


def test_repairs(spark, labelled):
    lex = rerank.build(labelled)
    rows = [("p", 0, 0, "1 IVSdd 0.9 cm", 0.9, "primary", 0), ("p", 0, 1, "IVSd 9.0 mm", 0.9, "primary", 0), ("p", 0, 2, "1 IVSd 0.9 cm", 0.9, "primary", 0), ("p", 0, 3, "IVSd 9.0 cm", 0.9, "primary", 9)]
    d = with_parsed(spark.createDataFrame(rows, "panel_id string, line_order int, cand_pos int, text string, confidence double, source string, expected_char_count int"))
    got = {(r.cand_pos, r.text, r.source) for r in rerank.repairs(d, lex).collect()}
    assert got == {(1000, "1 IVSd 0.9 cm", "primary_lexicon_repair"), (1001, "1 IVSd 0.9 cm", "primary_family_repair")}


def test_blob_recovery(spark):
    rows = [(1, "1 LVOT Diam 2.1 cm\n2 AV Vmax 2.5 m/s", 2), (2, "1 LVOT Diam 2.1 cm 2 AV Vmax 2.5 m/s", 2), (3, "1 LVOT Diam 2.1 cm", 3), (4, "A 1 cm\nB 2 cm\nC 3 cm", 4), (5, "1 LALs A4C 6.1 cm LAAs A4C 23.4 cm2 LAESV A-L A4C 77 ml", 4), (6, "", 2), (7, None, 2)]
    got = {r.blob_id: (r.lines, r.source) for r in recover.recover_lines(spark.createDataFrame(rows, "blob_id int, text string, target_line_count int")).collect()}
    assert got[1] == (["1 LVOT Diam 2.1 cm", "2 AV Vmax 2.5 m/s"], "raw_newlines") and got[2][0] == ["1 LVOT Diam 2.1 cm", "2 AV Vmax 2.5 m/s"]
    assert got[3][0] == ["1 LVOT Diam 2.1 cm"] and got[4][1] == "raw_newlines_relaxed" and len(got[4][0]) == 3
    assert got[5] == (["1 LALs A4C 6.1 cm", "LAAs A4C 23.4 cm2", "LAESV A-L A4C 77 ml"], "unit_boundary_split") and got[6][0] == [] and got[7][0] == []


def test_blobs_are_cut_without_their_spans(spark, monkeypatch):
    asked, spans = [], recover.spans
    monkeypatch.setattr(recover, "spans", lambda blobs, *a: asked.append(blobs) or spans(blobs, *a))
    long = [f"{i} {' '.join(['Lv'] * 14)} {i}.5 cm" for i in range(1, 9)]  # lines of more tokens than short spans had
    rows = [(1, " ".join(long), 8), (2, "A 1 cm B 2 mm", None), (3, "A B C", None), (4, "12 éa 3 cm l Ao 4 s", 2), (5, "AV Vmax", 2)]
    got = {r.blob_id: (r.lines, r.source) for r in recover.recover_lines(spark.createDataFrame(rows, "blob_id int, text string, target_line_count int")).collect()}
    assert got[1] == (long, "unit_boundary_split") and got[2] == (["A 1 cm", "B 2 mm"], "unit_boundary_split")
    assert got[3] == (["A B C"], "fallback_raw_text") and got[4] == (["12 éa 3 cm", "1 Ao 4 s"], "unit_boundary_split")
    assert sorted(r.blob_id for d in asked for r in d.collect()) == [3, 5]


def test_label_files(spark, tmp_path):
    payload = {"version": 1, "task": records.LABEL_TASK, "files": [{"file_name": "a", "file_path": "/x/a", "split": "Train", "measurements": [{"order": 1, "text": " A 1 cm "}, {"order": "x", "text": "B 2 cm"}, {"order": 3, "text": " "}]}]}
    (tmp_path / "l.json").write_text(json.dumps(payload))
    got = records.read_labels(spark, f"file://{tmp_path}/l.json")
    assert [(r.split, r.pos, r.line_order, r.text) for r in got.orderBy("pos").collect()] == [("train", 1, 1, "A 1 cm"), ("train", 2, None, "B 2 cm")]
    assert records.read_labels(spark, f"file://{tmp_path}/l.json", strict_order=True).count() == 1
    records.write_labels(got, f"file://{tmp_path}/out")
    assert records.read_labels(spark, f"file://{tmp_path}/out").count() == 2
    for bad in ({"version": 2}, {"task": "other"}, {"files": [{"file_name": "a", "split": "", "measurements": [{"order": 1, "text": "x"}]}]}):
        (tmp_path / "bad.json").write_text(json.dumps(payload | bad))
        with pytest.raises(Exception, match="label file|no split"):
            records.read_labels(spark, f"file://{tmp_path}/bad.json").collect()


def test_items_and_resume(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"dicom_path":"a","status":"ok","measurements":[{"name":"n","value":"1"}]}\n{"dicom_path":"b","status":"error","error":{"type":"T","message":"m"}}\nnot json\n')
    items = records.read_items(spark, f"file://{tmp_path}/c.json")
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert {r.path for r in records.pending(todo, items).collect()} == {"c"} and {r.path for r in records.pending(todo, items, True).collect()} == {"b", "c"}
    assert {(r.dicom_path, r.name, r.error) for r in records.flat_items(items).collect()} == {("a", "n", ""), ("b", "", "m")}
    new = records.upsert(spark.createDataFrame([("k", 1, "old"), ("j", 1, "j")], "file_path string, version int, v string"), spark.createDataFrame([("k", 2, "new")], "file_path string, version int, v string"))
    assert {(r.file_path, r.v) for r in new.collect()} == {("k", "new"), ("j", "j")}


def test_loose_json(spark):
    rows = ['x [{"order":2,"name":"A","value":"1"}] y', '{"measurements":[{"name":"B","value":"2","unit":"cm"}]}', "nothing", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(records.reply_measurements(F.col("t")))
    assert [[tuple(x) for x in r[0]] for r in d.collect()] == [[(1, "A", "1", None)], [(0, "B", "2", "cm")], [], []]


def test_files(spark, tmp_path):
    for n in ("p1/e1/a.dcm", "p1/e2/a.DCM", "p2/e1/b.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    root = f"file://{tmp_path}"
    assert files.discover(spark, root).count() == 1 and files.discover(spark, root, any_case=True).count() == 2
    labels = spark.createDataFrame([("C:\\data\\p1\\e1\\a.dcm",), ("z/none.dcm",)], "path string")
    disk = spark.createDataFrame([("/r/p1/e1/a.dcm",), ("/r/p9/e1/a.dcm",)], "path string")
    assert {(r.label_path[-5:], r.file_path) for r in files.match_labels(labels, disk).collect()} == {("a.dcm", "/r/p1/e1/a.dcm"), ("e.dcm", None)}
    assert spark.range(1).select(files.reroot(F.lit("C:\\data\\x\\a"), {"/data": "/mnt/d"})).first()[0] == "/mnt/d/x/a"


def test_reports(spark):
    tree = [{"value_type": "CONTAINER", "children": [{"value_type": "NUM", "concept": "PV  Vmax", "numeric_value": "0.87", "unit_code": "m/s"}, {"value_type": "TEXT", "concept": "IVSd", "text": "0.9 cm"}]}]
    texts = [{"value_type": "TEXT", "concept": "IVSd", "text": "0.9 cm"}]
    d = spark.createDataFrame([("a", json.dumps(tree)), ("b", json.dumps(texts)), ("c", None)], "path string, content string")
    got = {(r.path, r.name, r.value, r.unit, r.confidence) for r in reports.measurements(reports.walk(d)).collect()}
    assert got == {("a", "PV Vmax", "0.87", "m/s", 0.995), ("b", "IVSd", "0.9", "cm", 0.94)}
    f = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "3"), ("t", "4"), (None, "5")], "study_uid string, path string")
    assert reports.companions(f, 1).count() == 3


def test_file_stream_takes_files_once(spark, tmp_path):
    src, out, check = (tmp_path / n for n in ("in", "out", "check"))
    src.mkdir()
    (src / "a.txt").write_text("1 IVSd 0.9 cm\nnothing here\n")
    run = lambda: batch.run_once(batch.parsed_stream(batch.line_files(spark, str(src))), str(out), str(check)).awaitTermination()
    run()
    assert {r.status: r["count"] for r in spark.read.parquet(str(out)).groupBy("status").count().collect()} == {"ok": 1, "skipped": 1}
    run()
    (src / "b.txt").write_text("2 LVIDd 5.4 cm\n")
    run()
    assert spark.read.parquet(str(out)).count() == 3


def test_configs(spark):
    names = lambda **k: {r.name for r in configs.factorial(spark, **({"scales": [2], "bins": ["otsu"], "orders": ["st", "ts"], "recipes": ["plain"], "inputs": ["gray"]} | k)).collect()}
    assert names() == {"om_gray_pln_s2_otsu_st_mc_mv0", "om_gray_pln_s2_otsu_ts_mc_mv0"}
    assert names(scales=[1, 2], bins=["none"]) == {"om_gray_pln_s1_nbin_st_mv0", "om_gray_pln_s2_nbin_st_mv0"}
    assert names(scales=[1]) == set() and len(names(scales=[1], bin_at_1x=True)) == 2
    plan = configs.plan_configs(spark)
    assert plan.count() == 8 and configs.select_configs(plan, exclude=["plan_no_binarize_1x"]).count() == 7


def test_registry(spark):
    r = registry.Registry()
    with pytest.raises(ValueError):
        r.run(spark.range(1))
    r.register("noop", registry.noop)
    r.register("none", lambda d: d.limit(0))
    assert r.run(spark.range(2)).count() == 2
    r.use("none")
    assert r.run(spark.range(2)).count() == 0 and r.names() == ["none", "noop"]
    a = spark.createDataFrame([("x", "error"), ("y", "ok")], "path string, status string")
    b = spark.createDataFrame([("x", "ok"), ("y", "ok")], "path string, status string")
    assert {(q.path, q.engine) for q in registry.first_success({"a": a, "b": b}).collect()} == {("x", "b"), ("y", "a")}


def test_pixels(spark):
    frame = np.zeros((90, 240, 3), np.uint8)
    frame[10:60, 5:200] = pixels.PANEL_RGB
    frame[20:28, 20:100] = 250
    frame[40:48, 20:60] = 250
    assert pixels.find_panel(frame) == (5, 10, 195, 50)
    rows = [("a", 0, 90, 240, 3, bytearray(frame.tobytes())), ("b", 0, 9, 9, 3, bytearray(b"short"))]
    got = {r.path: r for r in pixels.segment_frames(spark.createDataFrame(rows, "path string, frame_index int, height int, width int, channels int, pixels binary")).collect()}
    assert [tuple(x) for x in got["a"].rows] == [(20, 20, 80, 8), (20, 40, 40, 8)] and got["b"].error.startswith("ValueError")
    assert pixels.runs_of([1, 0, 1, 0, 0, 1], fill=1) == [(0, 3), (5, 6)] and pixels.gap_midpoints([(0, 3), (5, 6)]) == [4]
    stack = np.random.default_rng(1).integers(0, 255, (6, 40, 50)).astype(np.uint8)
    score, _, frame_at, zoom = pixels.zoom_scores(stack[4], stack)
    assert (frame_at, zoom) == (4, 1.0) and score > 0.999
    assert pixels.order_alignment(["a", "b", "c"], ["a", "c"], lambda x, y: 1.0 if x == y else -1.0) == [(0, 0), (1, None), (2, 1)]

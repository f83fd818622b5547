from __future__ import annotations

from pyspark.sql import functions as F

from calipra.operators import summaries as S


def test_headers(spark):
    rows = [({"RecommendedDisplayFrameRate": "25", "FrameTime": "10"},), ({"FrameTime": "20", "NumberOfFrames": "7"},), ({"FrameTime": "x", "NumberOfFrames": "-1"},), ({},)]
    d = spark.createDataFrame(rows, "h map<string,string>").select(S.frame_timing(F.col("h")).alias("t"), S.frame_count(F.col("h")).alias("n")).collect()
    assert [(round(r.t.fps, 3), r.n) for r in d] == [(25.0, 1), (50.0, 7), (30.0, 1), (30.0, 1)]


def test_issues_and_mismatches(spark):
    schema = "path string, error struct<type:string,message:string>, measurements array<struct<name:string,value:string,flags:array<string>>>, lines array<struct<text:string,manual_verify_required:boolean>>"
    d = spark.createDataFrame([("a", ("T", "m"), [], []), ("b", None, [("n", "1", ["f"]), ("o", "2", [])], [("x", True), ("y", False)])], schema)
    assert {tuple(r) for r in S.issues(d).collect()} == {("a", "error", "T: m"), ("b", "flag", "n 1 f"), ("b", "manual", "x")}
    m = spark.createDataFrame([("a", "train", True), ("a", "validation", False), ("b", "train", True)], "file_name string, split string, line_match boolean")
    assert S.mismatches(m, "file_name", split="validation").count() == 1 and [r.file_name for r in S.hard_cases(m, 3).collect()] == ["a"]


def test_boxes_policies_queues(spark):
    d = spark.createDataFrame([([[0, 0, 10, 10]],), ([[50, 50, 90, 90]],)], "b array<array<int>>")
    assert [r[0] for r in d.select(S.infer_box_format(F.col("b"), F.lit(100), F.lit(100))).collect()] == ["xywh", "xyxy"]
    pick = lambda *n: spark.range(1).select(S.count_policy(*map(F.lit, n))).first()[0]
    assert [pick(3, 3, 3, 3), pick(3, 3, 2, 1), pick(3, 2, 3, 1), pick(3, 1, 1, 1)] == ["current", "vertical", "blob", "current"]
    q = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 3)], "path string, pos int")
    assert {r.path for r in S.review_queue(q, "b").collect()} == {"b", "c"} and S.review_queue(q).count() == 3 and S.review_queue(q, "zz").count() == 3

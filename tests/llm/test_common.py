from __future__ import annotations

import os

from pyspark.sql import functions as F

from calipra.llm.common import ascii_lower, bound_batches, materialize, new_path, release


def test_tables_in_the_shared_folder(spark):
    d = materialize(spark.range(5), "five")
    assert d.count() == 5
    folder = os.path.dirname(new_path(spark, "x")).removeprefix("file://")
    assert any(n.startswith("five-") for n in os.listdir(folder))
    release(spark)
    assert not os.path.exists(folder)


def test_ascii_lower(spark):
    d = spark.createDataFrame([("ABC z",), ("ÀÉ A",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(ascii_lower(F.col("t"))).collect()] == ["abc z", "ÀÉ a", "", None]


def test_a_sessions_own_batch_size_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "777")
        bound_batches(spark)
        assert spark.conf.get(key) == "777"
    finally:
        spark.conf.set(key, before)

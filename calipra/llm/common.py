"""What several operators share: the shared folder, size checks and text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to Python, where the session leaves Spark's own number: texts are long, and a worker holds a batch or two.
BATCH_ROWS, _SPARKS_OWN = 256, "10000"
#: Prefix of columns that operators add for a while; input columns must not start with it.
OWN = "__calipra_"


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir, which is set here only where it is unset.

    The default is a temporary folder of this machine, for tests in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="calipra-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/calipra-{spark.sparkContext.applicationId}"


def bound_batches(spark: SparkSession) -> None:
    """Bounds what Python workers and the buffers before them hold at a time. A number that the session was given stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == _SPARKS_OWN:
        spark.conf.set(key, BATCH_ROWS)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that materialize() wrote in this application; call it once results are written."""
    delete(spark, shared_dir(spark))


_made: list[str] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were written within; for work whose result is written elsewhere by then."""
    before = len(_made)
    yield
    while len(_made) > before:
        delete(spark, _made.pop())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are. lower() is much faster and the same where all is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(*cols: Column) -> Column:
    """A key of a row by what it holds; equal rows share it, so results by it are joined once and hold for each."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))

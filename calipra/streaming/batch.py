"""Files as a stream: each is taken once, failures are rows, and a second run takes only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from calipra.functions.parse import with_parsed


def line_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """STM-1: a stream of the lines of text files below a folder, with their file's path."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parsed_stream(lines: DataFrame) -> DataFrame:
    """Lines parsed; a line without measurement is a row with its reasons (STM-4), never an error."""
    d = with_parsed(lines)
    return d.select("path", "text", "canonical", *[F.col(f"parsed.{c}") for c in ("prefix", "label", "value", "unit", "confidence")], F.when(F.col("parsed.is_measurement"), "ok").otherwise("skipped").alias("status"), F.array_join("parsed.reasons", ",").alias("reasons"))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """STM-1: takes all that is there, then ends. What was taken is in the checkpoint, so another run takes what came since."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_metrics(reviews: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """STM-9: running approved, corrected and accuracy over a stream of review events (approved, corrected), given to sink whenever they change."""
    total = reviews.agg(F.sum("approved").alias("approved"), F.sum("corrected").alias("corrected"))
    total = total.withColumn("accuracy", F.when(F.col("approved") + F.col("corrected") > 0, F.col("approved") / (F.col("approved") + F.col("corrected"))).otherwise(0.0))
    return total.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_latency(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """AGG-10 over a stream: count and mean of latencies by engine and window; what comes later than the watermark is left out, so state is bounded."""
    d = events.withWatermark("ts", late)
    return d.groupBy(F.window("ts", width), F.col("event_type").alias("engine")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_ms"))

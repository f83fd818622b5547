"""Summaries and projections of runs: files without findings, load audits, issues, headers, class and pixel statistics, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def never_found(frames: DataFrame, key: str = "path", found: str = "roi") -> DataFrame:
    """AGG-19: files none of whose frames has a finding, with their number of frames."""
    return frames.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"), F.count(found).alias("n_found")).filter("n_found = 0").drop("n_found")


def load_summary(audit: DataFrame) -> DataFrame:
    """AGG-20: files, failures, total and mean duration of a load audit (ok, duration)."""
    return audit.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("ok")).alias("n_failed"), F.round(F.sum("duration"), 6).alias("total_s"), F.round(F.avg("duration"), 6).alias("mean_s"))


def slowest(audit: DataFrame, n: int = 5, key: str = "path") -> DataFrame:
    """SRT-8: the n slowest files; a top-k."""
    return audit.orderBy(F.desc("duration"), key).limit(n)


def value_moments(df: DataFrame, column: str) -> DataFrame:
    """AGG-22: mean and standard deviation by sums and sums of squares."""
    x = F.col(column).cast("double")
    n, s, q = F.count(x), F.sum(x), F.sum(x * x)
    return df.agg(n.alias("n"), F.round(s / n, 6).alias("mean"), F.round(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))), 6).alias("std"))


def retry_summary(lines: DataFrame, *by: str) -> DataFrame:
    """AGG-9, AGG-27: counters of a panel's lines (uncertain, fallback, accepted, manual: booleans)."""
    return lines.groupBy(*by).agg(F.count_if("uncertain").alias("uncertain_lines"), F.count_if("fallback").alias("fallback_invocations"), F.count_if(F.col("fallback") & F.col("accepted")).alias("fallback_accepts"), F.count_if(F.col("fallback") & ~F.col("accepted")).alias("fallback_rejects"), F.count_if("manual").alias("manual_lines"))


def distinct_sources(df: DataFrame, *by: str, source: str = "source") -> DataFrame:
    """AGG-28: the different sources of a group, in order."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def issues(items: DataFrame) -> DataFrame:
    """FLT-17: a row for each error, flagged measurement and line that needs a look, of items with error, measurements (with flags) and lines."""
    errors = items.filter("error is not null").select("path", F.lit("error").alias("kind"), F.concat_ws(": ", "error.type", "error.message").alias("detail"))
    flagged = items.select("path", F.explode("measurements").alias("m")).filter(F.size("m.flags") > 0).select("path", F.lit("flag").alias("kind"), F.concat_ws(" ", "m.name", "m.value", F.array_join("m.flags", ",")).alias("detail"))
    manual = items.select("path", F.explode("lines").alias("l")).filter("l.manual_verify_required").select("path", F.lit("manual").alias("kind"), F.col("l.text").alias("detail"))
    return errors.unionByName(flagged).unionByName(manual)


def mismatches(matches: DataFrame, *keep: str, split: str | None = None) -> DataFrame:
    """FLT-18, SNK-9: lines that don't match; of one split, if named."""
    d = matches.filter(~F.col("line_match"))
    if split is not None:
        d = d.filter(F.col("split") == split)
    return d.select(*keep) if keep else d


def hard_cases(matches: DataFrame, n: int, key: str = "file_name") -> DataFrame:
    """FLT-21, SRT-11: the first n files, by name, with a line that isn't exact."""
    d = matches.groupBy(key).agg(F.count(F.lit(1)).alias("expected"), F.count_if("line_match").alias("exact"))
    return d.filter("exact < expected").orderBy(key).limit(n)


def frame_timing(header: Column) -> Column:
    """SRC-10: fps and frame_time_ms of a map of header fields: the display rate, else 1000 / frame time, else 30."""
    number = lambda k: F.try_element_at(header, F.lit(k)).try_cast("double")
    shown, each = number("RecommendedDisplayFrameRate"), number("FrameTime")
    fps = F.coalesce(F.when(shown > 0, shown), F.when(each > 0, 1000.0 / each), F.lit(30.0))
    return F.struct(fps.alias("fps"), F.coalesce(F.when(each > 0, each), 1000.0 / fps).alias("frame_time_ms"))


def frame_count(header: Column) -> Column:
    """SRC-9: number of frames; 1 where it is missing, no number or not positive."""
    n = F.try_element_at(header, F.lit("NumberOfFrames")).try_cast("int")
    return F.coalesce(F.when(n > 0, n), F.lit(1))


def infer_box_format(boxes: Column, width: Column, height: Column) -> Column:
    """IMG-10: xywh or xyxy, by which reading of the boxes (arrays of four numbers) overflows a frame less; of equals xywh."""
    over = lambda v, most: F.greatest((v - most).cast("double"), F.lit(0.0))
    add = lambda acc, x: acc + x
    as_size = F.aggregate(F.transform(boxes, lambda b: over(b[0] + b[2], width) + over(b[1] + b[3], height)), F.lit(0.0), add)
    as_ends = F.aggregate(F.transform(boxes, lambda b: over(b[2], width) + over(b[3], height) + over(b[0], b[2]) + over(b[1], b[3])), F.lit(0.0), add)
    return F.when(as_size <= as_ends, "xywh").otherwise("xyxy")


def count_policy(n_expected: Column, n_vertical: Column, n_blob: Column, n_current: Column) -> Column:
    """SEQ-11: which of three recoveries to take: one whose number of lines is right, in this order, else the current one."""
    return F.when(n_current == n_expected, "current").when(n_vertical == n_expected, "vertical").when(n_blob == n_expected, "blob").otherwise("current")


def review_queue(files: DataFrame, current: str | None = None, order: str = "pos") -> DataFrame:
    """WIN-11: each path once, at its first place; from the current one on, if it is there."""
    first = files.groupBy("path").agg(F.min(order).alias(order))
    if current is None:
        return first
    at = first.filter(F.col("path") == current).agg(F.coalesce(F.min(order), F.lit(-1)).alias("at"))  # one row
    return first.crossJoin(F.broadcast(at)).filter(F.col(order) >= F.col("at")).drop("at")


def remap_orders(lines: DataFrame, *panel: str, order: str = "line_order") -> DataFrame:
    """WIN-13: the place of each line among its panel's lines with text, from 0, beside its own order."""
    w = Window.partitionBy(*panel).orderBy(order)
    return lines.filter(F.trim("text") != "").withColumn("text_order", F.row_number().over(w) - 1)

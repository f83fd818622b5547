"""Line dedup by site-relative frequency, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calipra.llm.common import OWN, ascii_lower, materialize

#: A line on more than this share of its host's pages is boilerplate ...
MAX_RATIO = 0.01
#: ... if it is on so many pages at least: of a host with few pages, any line has a large share.
MIN_PAGES = 4
#: So many boilerplate lines (16 bytes each) are sent to all executors; beyond it, lines and rows are joined by shuffles.
BROADCAST_LINES = 50_000


def _line_id(host: Column, line: Column) -> Column:
    return F.xxhash64(host, F.trim(line))


def _ids(host: Column, text: Column) -> Column:
    """The ids of a page's lines that hold more than blanks, each once."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: _line_id(host, x)))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_id, n_pages, n_host): the lines that are on more than max_ratio of their host's pages.

    Each row is a page and counts once for a line, however often the line is on it. Lines are shuffled as
    64-bit ids that are counted before and after; of hosts, only totals move.
    """
    p = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = p.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    counts = (
        p.select("host", F.explode(_ids(F.col("host"), F.col("text"))).alias("line_id"))
        .groupBy("host", "line_id")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )
    same = counts["host"].eqNullSafe(totals["host"])
    return counts.join(totals, same).select(counts["host"], "line_id", "n_pages", "n_host").filter(F.col("n_pages") > max_ratio * F.col("n_host"))


def host_of(url: Column) -> Column:
    """The host of a URL, A-Z lower-cased: the site of a page. Empty without ://, null for null."""
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def line_dedup(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """All rows and columns of pages, with text less its host's boilerplate lines, and n_lines and n_dropped (both int).

    Lines end at a line feed and are compared without blanks around them; empty lines are kept and never counted.
    A page all of whose lines are boilerplate, such as a copy of many others of its host, keeps its row and its empty lines.
    Rows with a null host count as pages of one more host. Null text stays null, with no lines; empty text stays empty.
    Columns of pages named n_lines or n_dropped are replaced.
    """
    kept_cols = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    bad = materialize(boilerplate(pages, host, text, max_ratio, min_pages).select("host", "line_id"), "boilerplate")
    h, t = F.col(host), F.col(text)
    drop = f"{OWN}drop"
    if bad.limit(broadcast_lines + 1).count() <= broadcast_lines:
        by_host = bad.groupBy(F.col("host").alias(f"{OWN}host")).agg(F.collect_list("line_id").alias(drop))
        joined = pages.join(F.broadcast(by_host), h.eqNullSafe(F.col(f"{OWN}host")), "left")
    else:
        # line ids meet the boilerplate, then rows meet their own boilerplate lines; equal rows share a key and its lines
        key = F.xxhash64(h, t)
        lines = pages.select(h.alias("host"), key.alias(f"{OWN}key"), F.explode(_ids(h, t)).alias("line_id"))
        own = lines.join(bad.select("line_id").distinct(), "line_id", "left_semi").groupBy(f"{OWN}key").agg(F.collect_set("line_id").alias(drop))
        joined = pages.withColumn(f"{OWN}row", key).join(own, F.col(f"{OWN}row") == F.col(f"{OWN}key"), "left")
    lines, none = F.split(t, "\n"), F.coalesce(F.col(drop), F.array().cast("array<bigint>"))
    full = F.filter(lines, lambda x: F.trim(x) != "")
    left = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(none, _line_id(h, x)))
    out = joined.withColumn(f"{OWN}n", F.coalesce(F.size(full), F.lit(0))).withColumn(f"{OWN}left", left)
    n_left = F.coalesce(F.size(F.filter(F.col(f"{OWN}left"), lambda x: F.trim(x) != "")), F.lit(0))
    dropped = F.col(f"{OWN}n") - n_left
    new = {text: F.when(dropped > 0, F.array_join(f"{OWN}left", "\n")).otherwise(t), "n_lines": F.col(f"{OWN}n"), "n_dropped": dropped.cast("int")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in [*kept_cols, "n_lines", "n_dropped"]])

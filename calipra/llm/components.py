"""Connected components of links: union-find in each partition, then star contractions over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calipra.llm.common import materialize

#: Links that one task's union-find takes at once.
LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as links from each node to the smallest node that it reaches there. Memory: the partition's nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.setdefault(top, top)) != top:
            top = p
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    links = [(u, r) for u in up if (r := root(u)) != u]
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], names=["u", "v"])


def _is_stars(links: DataFrame) -> bool:
    """Whether each node has one link, and that to a node without one."""
    twice = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    inner = links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi").limit(1)
    return twice.isEmpty() and inner.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): of each node in links (u, v: long), the smallest node reachable, where that isn't itself.

    Few links are one task's work. Of more, a node of very many is no task's burden: minima are taken before the shuffle, and the joins by node are ones that Spark
    splits where a key is large. No links or labels reach the driver, only whether the work is done.
    """
    links = materialize(links.filter(F.col("u") != F.col("v")).select(F.col("u").cast("long"), F.col("v").cast("long")), "all-links")
    tasks = -(-links.count() // LINKS)
    if tasks <= 1:  # one task's forest is one of stars
        return links.coalesce(1).mapInArrow(_forest, "u long, v long").toDF("node", "component")
    e = materialize(links.coalesce(tasks).mapInArrow(_forest, "u long, v long").distinct(), "forest")
    while not _is_stars(e):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(e.filter("u <> v").distinct(), "large-star")
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
        e = materialize(e.distinct().mapInArrow(_forest, "u long, v long").distinct(), "small-star")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))

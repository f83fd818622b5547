"""Exact top-k search by distributed histogram selection over integer inner products."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calipra.llm.common import materialize

#: Bytes of the query vectors that are sent to all workers at a time, about; queries whose scores with a batch a task holds at a time.
QUERY_BYTES, TILE = 16 << 20, 512
#: Each round splits the range that holds a query's kth score into so many bins.
BINS = 1024
#: Below it, sums of products of doubles are exact integers; scores from the other on do not fit a long.
EXACT, LIMIT = 2**53, 2**62
#: Stands for a score that does not count.
_NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim): components as floor(scale * x). Rows without id, and vectors that are null, empty or hold null or non-finite components, take no part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & fine & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim"))


def _by_dim(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places, matrix) of the vectors of each dimension."""
    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        column = table.column("v").take(pa.array(at))
        flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
        yield int(dim), at, flat.to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if np.abs(c).max() * np.abs(q).max() * c.shape[1] < EXACT:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _tiles(block: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(dim, slice of queries, scores, candidates' ids, which ascend), a query's own id standing for none."""
    for batch in batches:
        for dim, at, c in _by_dim(batch):
            if dim in block:
                ids = batch.column("vec_id").to_numpy()[at]
                order = np.argsort(ids, kind="stable")
                ids, c, own = ids[order], c[order], block[dim]
                for i in range(0, len(own["id"]), TILE):
                    of = slice(i, i + TILE)
                    s = _scores(own["v"][of], c)
                    s[own["id"][of, None] == ids[None, :]] = _NONE
                    yield dim, of, s, ids


def _histograms(sent, width: int, k: int) -> Callable:
    """Of each query: how many of a task's scores fall into each bin of its range, from the highest bin to where the task's alone are k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        tops = {dim: np.full((len(own["id"]), k), _NONE) for dim, own in block.items()}
        for dim, of, s, _ in _tiles(block, batches):
            lo = block[dim]["lo"][of, None]
            s[(s < lo) | (s >= lo + width * BINS)] = _NONE
            both = np.concatenate([tops[dim][of], s], axis=1)
            tops[dim][of] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        for dim, top in tops.items():
            own = block[dim]
            at, place = np.nonzero(top != _NONE)
            bins, n = np.unique(at * BINS + (top[at, place] - own["lo"][at]) // width, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own["key"][bins // BINS]), pa.array(bins % BINS), pa.array(n.astype(np.int64))], names=["key", "bin", "n"])

    return run


def _selected(sent) -> Callable:
    """Scores above each query's kth one, and of those equal to it the ones of the smallest ids, no more of a batch than can be among the first k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for dim, of, s, ids in _tiles(block, batches):
            own = {name: x[of] for name, x in block[dim].items()}
            ties = (s == own["lo"][:, None]) & (s != _NONE)
            ties &= np.cumsum(ties, axis=1) <= own["need"][:, None]
            at, place = np.nonzero(ties | (s > own["lo"][:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(own["key"][at]), pa.array(own["id"][at]), pa.array(ids[place]), pa.array(s[at, place])], names=["key", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with all other rows, ties to smaller vec_id.

    Candidates stay where they are: in each round, each task scores all of its own against a block of queries that is sent to
    all workers, and only histograms leave it, of k bins a query at most. Blocks have bounded bytes and are worked one after
    the other. Round by round the range that holds a query's kth score shrinks by BINS, till it is one integer; then scores
    above it, and the ties that can count, are kept. A query with fewer than k others gets them all. Rows with the query's own
    vec_id never count; vectors of another dimension neither. Equal rows among the candidates each count; equal queries count
    once. See usable() for what takes no part; is_query is a condition on id_col; ids are integers. Components so large that
    scores might not fit a long are an error.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    v = materialize(usable(vectors, id_col, vector), "vectors")
    q = usable(vectors.filter(is_query), id_col, vector).distinct()
    norm = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    n, longest = v.agg(F.count(F.lit(1)), norm).first()
    n_q, longest_q, size = q.agg(F.count(F.lit(1)), norm, F.sum("dim")).first()
    if not n or not n_q:
        return none
    if longest * longest_q >= LIMIT:
        raise ValueError("components are so large that scores might not fit a long")
    bound = math.ceil(longest * longest_q * (1 + 1e-9)) + 1  # no score is beyond it (Cauchy and Schwarz)
    rounds = max(1, math.ceil(math.log(2 * bound + 1, BINS)))
    n_blocks = math.ceil(8 * size / query_bytes)
    # a query's number holds for this one table, which is written
    q = materialize(q.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")).withColumn("key", F.monotonically_increasing_id()), "queries")
    v = v.coalesce(4 * spark.sparkContext.defaultParallelism)
    chosen = []
    for b in range(n_blocks):
        table = q.filter(F.col("block") == b).toArrow()  # query_bytes, about
        block = {
            dim: {"key": table["key"].to_numpy()[at], "id": table["vec_id"].to_numpy()[at], "v": m, "lo": np.full(len(at), -bound, np.int64), "need": np.full(len(at), k, np.int64)}
            for dim, at, m in _by_dim(table)
        }
        for r in range(rounds):
            width = BINS ** (rounds - 1 - r)
            sent = spark.sparkContext.broadcast(block)
            found = v.mapInArrow(_histograms(sent, width, k), "key long, bin long, n long").groupBy("key", "bin").agg(F.sum("n").alias("n"))
            from_top = Window.partitionBy("key").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
            needs = spark.createDataFrame(pa.table({"key": np.concatenate([x["key"] for x in block.values()]), "need": np.concatenate([x["need"] for x in block.values()])}))
            cum = found.withColumn("cum", F.sum("n").over(from_top)).join(F.broadcast(needs), "key")  # a row a query of the block
            at = cum.filter((F.col("cum") >= F.col("need")) & (F.col("cum") - F.col("n") < F.col("need"))).select("key", "bin", (F.col("need") - F.col("cum") + F.col("n")).alias("need")).toArrow()
            told = dict(zip(at["key"].to_pylist(), zip(at["bin"].to_pylist(), at["need"].to_pylist(), strict=True), strict=True))
            block = {dim: _narrowed(own, told, width) for dim, own in block.items()}
            sent.unpersist()
        sent = spark.sparkContext.broadcast(block)
        chosen.append(materialize(v.mapInArrow(_selected(sent), "key long, query_id long, vec_id long, score long"), "chosen"))
        sent.unpersist()
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _narrowed(own: dict, told: dict[int, tuple[int, int]], width: int) -> dict:
    """The queries with the bin that holds their kth score as their range; those with fewer than k others have no kth score, and all scores are above theirs."""
    lo, need = own["lo"].copy(), own["need"].copy()
    for i, key in enumerate(own["key"].tolist()):
        if key in told:
            lo[i] += told[key][0] * width
            need[i] = told[key][1]
        else:
            lo[i] = _NONE
    return own | {"lo": lo, "need": need}

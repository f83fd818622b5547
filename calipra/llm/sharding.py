"""Uniform shuffle into shards of exact sizes: a hypergeometric matrix of counts, local permutations, exchange, and permutations again."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calipra.llm.common import OWN, materialize

#: Rows of a block at most on average, and blocks at most: the matrix has blocks x shards counts, on the driver.
BLOCK_ROWS, MAX_BLOCKS = 500_000, 4096
#: Equal rows are dealt in pieces of so many at most.
PIECE = 1024


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart, the larger ones first."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows, drawn from good + bad ones, are good: hypergeometric, by inversion, for numbers of any size.

    Chances fall from the likeliest number on by the ratios of neighbours, so that no factorials are rounded. What is
    farther from it than 12 deviations and 40 has a chance below 1e-15 and is left out.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    top = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = 40 + math.ceil(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))))
    k = np.arange(max(low, top - reach), min(high, top + reach), dtype=float)
    ratio = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # of k + 1 to k
    at = top - max(low, top - reach)
    weights = np.concatenate([np.cumprod(1 / ratio[:at][::-1])[::-1], [1.0], np.cumprod(ratio[at:])])
    ends = np.cumsum(weights)
    return int(max(low, top - reach) + min(np.searchsorted(ends, rng.random() * ends[-1], side="right"), len(ends) - 1))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows of each block go to each shard: row sums are the blocks' counts, column sums the shards'."""
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards must hold as many rows")
    rng, room, out = np.random.default_rng(seed), list(shards), []
    for n in blocks:
        row, left = [], n
        for k, r in enumerate(room):
            row.append(_draw(rng, r, sum(room[k + 1 :]), left))
            left -= row[-1]
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of docs: id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('rows'), shard, slot (from 0, no gaps) and copy (from 0, of equal rows).

    Texts aren't moved: ids, sizes and checksums (24 bytes a row) are. A row's block is a hash of them rather than a
    partition of the scan, so that a lost executor's tasks run again to the same result. Equal rows count as one with
    a number until they have ranks, so that many of them make no block larger than the others to sort, and are then dealt in pieces. An empty table has
    empty shards. Null texts have size 1; null ids are values like others. The order in a shard is that of a second hash.
    """
    name = docs.schema[id_col].name
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"))
    d = materialize(d.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    rows = d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = min(MAX_BLOCKS, max(1, math.ceil(rows / block_rows), *([16] if rows > 10_000 else [])))
    block = F.pmod(F.xxhash64(F.lit(seed), "id", "size", "crc"), F.lit(n_blocks)).cast("int")
    d = d.withColumn("block", block)
    counts = {r.block: r.n for r in d.groupBy("block").agg(F.sum("n").alias("n")).collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(n_blocks)], shard_sizes(rows, shards), seed)
    ends = [(b, np.cumsum(row).tolist()) for b, row in enumerate(matrix)]
    table = d.sparkSession.createDataFrame(ends, "block int, ends array<bigint>")  # at most MAX_BLOCKS rows
    # first permutation: rank in the block by a hash; rank decides the shard by the matrix
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "id", "size", "crc"), "id", "size", "crc")
    ranked = d.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    pieces = ranked.join(F.broadcast(table), "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE))))
    if d.filter(F.col("n") > PIECE).limit(1).count():  # the pieces of one row's copies go to many tasks
        pieces = pieces.repartition("id", "size", "crc", "piece")
    last = F.least("n", (F.col("piece") + 1) * PIECE) - 1
    each = pieces.select("id", "size", "crc", "before", "ends", F.explode(F.sequence(F.col("piece") * PIECE, last)).alias("copy"))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("before") + F.col("copy")))
    # second permutation: by another hash, in cells of a shard whose first slots come from counts
    key = F.xxhash64(F.lit(seed + 2), "id", "size", "crc", "copy")
    n_cells = max(1, math.ceil(n_blocks / shards))
    put = each.select("id", "size", "crc", "copy", shard.cast("int").alias("shard"), key.alias("key"))
    put = materialize(put.withColumn("cell", F.floor((F.shiftright("key", 32) + F.lit(2**31)) * F.lit(n_cells) / F.lit(2.0**32)).cast("int")), "shard-cells")
    cells = {(r.shard, r.cell): r.n for r in put.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [(s, c, sum(cells.get((s, x), 0) for x in range(c))) for s, c in sorted(cells)]
    starts = d.sparkSession.createDataFrame(first, "shard int, cell int, start bigint")  # as many as blocks, about
    at = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "id", "size", "crc", "copy"))
    out = put.withColumn(f"{OWN}at", at.cast("long")).join(F.broadcast(starts), ["shard", "cell"])
    slot = F.col("start") + F.col(f"{OWN}at") - 1
    return out.select(F.col("id").alias(name), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("copy").cast("int").alias("copy"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes all columns of docs to path, partitioned by shard and sorted by slot; here texts are moved, once to meet their slots and once to their shards."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = {"i": F.col(id_col), "s": (F.octet_length(t) + 1).cast("long"), "c": F.crc32(t)}
    d = docs.withColumns({OWN + k: c for k, c in own.items()})
    d = d.withColumn(f"{OWN}n", F.row_number().over(Window.partitionBy(*[OWN + k for k in own]).orderBy(F.lit(0))) - 1)
    put = shard_rows(docs, shards, seed, id_col, text)
    put = put.select(F.col(id_col).alias(f"{OWN}pi"), F.col("size").alias(f"{OWN}ps"), F.col("text_crc32").alias(f"{OWN}pc"), F.col("copy").alias(f"{OWN}pn"), "shard", "slot")
    same = [F.col(f"{OWN}{k}").eqNullSafe(F.col(f"{OWN}p{k}")) for k in "iscn"]
    met = d.drop("shard", "slot").join(put, same).select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    met.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

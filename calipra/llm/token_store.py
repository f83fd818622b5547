"""Content-addressed store of token ids: chunks cut by a rolling hash and stored once, recipes of documents, and Merkle manifests."""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calipra.llm.bpe import Packed, byte_chars, is_plain, split_words
from calipra.llm.common import bound_batches, new_path

#: The id that ends a document.
END_ID = 2
#: Ids of a chunk: at least, about (a power of two) and at most; ids that the rolling hash looks back on, fewer than a chunk's least.
LEAST, ABOUT, MOST, REACH = 64, 512, 4096, 8
#: Chunks that a task remembers having sent.
SEEN = 1_000_000
#: Documents under one leaf of a block's tree, at most.
LEAF = 4096


class Encoder:
    """The ids of the tokenizers library.

    Of a plain byte-level file, the library's model encodes each different word once and the worker remembers its ids; a text that
    holds an added token, and any text under another file, goes through the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.plain = is_plain(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.library.model
        self.chars = {b: c for c, b in byte_chars().items()}
        self.blank = self.chars[ord(" ")]
        self.packed = Packed(self.word)

    def word(self, word: bytes) -> bytes:
        chars = word.decode("latin-1")
        chars = chars.replace(" ", self.blank) if chars.isascii() and chars.isprintable() else chars.translate(self.chars)  # others stand for themselves
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if self.plain and not any(a in text for a in self.added):
            return np.frombuffer(b"".join(map(self.packed.__getitem__, split_words(text))), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PLACES = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(REACH)], np.uint64)
#: Added to ids, so that small ones have all bits too.
_SALT = np.uint64(0xD1B54A32D192ED03)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of a document's chunks. A place is one where the hash of the last REACH ids has zeros on top, so that equal runs of ids are cut alike, whatever is before them."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    v = (ids.astype(np.uint64) + np.uint64(1)) * _SALT
    v ^= v >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for i in range(REACH):
        h[i:] += v[: n - i] * _PLACES[i]
    out, start = [], 0
    for at in [*(np.flatnonzero(h >> np.uint64(65 - ABOUT.bit_length()) == 0) + 1).tolist(), n]:
        while at - start > MOST:
            start += MOST
            out.append(start)
        if at - start >= LEAST or at == n and at > start:
            out.append(at)
            start = at
    return out


def pack(ids: np.ndarray) -> bytes:
    """A byte with the width (2 or 4), then the ids as little-endian numbers of that many bytes."""
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


# crc32 of a joined stream from its parts' (zlib's polynomial, fixed by the format)
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo zlib's, the highest bit being the constant."""
    p, bit = 0, 1 << 31
    while a:
        if a & bit:
            p ^= b
            a ^= bit
        bit >>= 1
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return p


@cache
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    out, base, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def crc_join(parts: list[tuple[int, int]]) -> int:
    """crc32 of what is joined, from the (crc32, bytes) of each part."""
    crc = 0
    for c, n in parts:
        crc = (_times(_shift(n), crc) if crc else 0) ^ c
    return crc


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents below path.

    pieces/kind=chunk: (digest, n_ids, payload), each digest once. recipes: (block, leaf, doc_id, row_id, n_tokens, root, chunks), blocks
    being ranges of ascending (doc_id, row_id) and leaves runs of LEAF documents of a block. manifest: (block, n_docs, n_tokens, start,
    root), and with block -1 the root of all. A document's root hashes its chunks' digests, a leaf's root its documents' roots, a
    block's root its leaves', the store's root the blocks'.

    Texts stay where they are. Chunks are shuffled by digest, once a task each; references to them are spread evenly, so that
    a chunk that all documents share is no task's burden. Null
    text counts as empty and has the end id alone; null ids come first; rows that repeat are documents of their own.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    # row ids hold for this one job, which writes them
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sent = encoder(tokenizer), set()
        for batch in batches:
            at, seq, digests, sizes, payloads = [], [], [], [], []
            for i, t in enumerate(batch.column(2)):
                ids = np.append(own(t.as_py() or ""), np.uint32(END_ID))
                start = 0
                for k, end in enumerate(cuts(ids)):
                    payload = pack(ids[start:end])
                    digest = hashlib.sha256(payload).digest()
                    at.append(i)
                    seq.append(k)
                    digests.append(digest)
                    sizes.append(end - start)
                    payloads.append(None if digest in sent else payload)
                    if len(sent) >= SEEN:
                        sent.clear()
                    sent.add(digest)
                    start = end
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(seq, pa.int32()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary())],
                names=["doc_id", "row_id", "seq", "digest", "n_ids", "payload"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: set[bytes] = set()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["ref"] * n), *batch.columns[:5], pa.nulls(n, pa.binary())], names=["kind", *batch.schema.names])
            digests, first = batch.column(3).to_pylist(), []
            for i, there in enumerate(batch.column(5).is_valid().to_pylist()):
                if there and digests[i] not in kept:
                    kept.add(digests[i])
                    first.append(i)
            take, m = pa.array(first, pa.int32()), len(first)
            of = lambda c, take=take: batch.column(c).take(take)
            yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * m, pa.string()), pa.nulls(m, batch.column(0).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), of(3), of(4), of(5)], names=["kind", *batch.schema.names])

    schema = f"doc_id {kind}, row_id long, seq int, digest binary, n_ids int, payload binary"
    spread = F.when(F.col("payload").isNull(), F.xxhash64("row_id", "seq"))
    pieces = rows.mapInArrow(encode, schema).repartition("digest", spread).mapInArrow(once, f"kind string, {schema}")
    pieces.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pieces")

    refs = spark.read.schema(f"{schema}, kind string").parquet(f"{path}/pieces").filter("kind = 'ref'")
    recipe = refs.groupBy("doc_id", "row_id").agg(F.sum("n_ids").cast("long").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "digest", "n_ids"))).alias("chunks"))
    root = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("chunks", lambda c: F.hex(c["digest"])), "")), 256))
    ordered = recipe.withColumn("root", root).repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id")
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    block, leaf = F.shiftright(place, 33).cast("int"), F.floor(place.bitwiseAND(F.lit(2**33 - 1)) / LEAF).cast("int")
    ordered.select(block.alias("block"), leaf.alias("leaf"), "doc_id", "row_id", "n_tokens", "root", "chunks").write.option("compression", "zstd").parquet(f"{path}/recipes")

    blocks = _block_roots(_recipes(spark, path, kind))
    found = sorted(blocks.collect())  # as many as the range has parts
    lines, start = [], 0
    for block, n_docs, n_tokens, block_root in found:
        lines.append((block, n_docs, n_tokens, start, bytearray(block_root)))
        start += n_tokens
    top = hashlib.sha256(b"".join(bytes(x[4]) for x in lines)).digest()
    lines.append((-1, sum(x[1] for x in lines), start, 0, bytearray(top)))
    spark.createDataFrame(lines, "block int, n_docs long, n_tokens long, start long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"block int, leaf int, doc_id {kind}, row_id long, n_tokens long, root binary, chunks array<struct<seq:int,digest:binary,n_ids:int>>").parquet(f"{path}/recipes")


def _block_roots(recipes: DataFrame) -> DataFrame:
    """(block, n_docs, n_tokens, root): documents' roots meet in leaves of bounded size, leaves' roots in blocks."""
    hashed = lambda *order: F.unhex(F.sha2(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.hex("root").alias("root")))), lambda d: d["root"]), "")), 256)).alias("root")
    leaves = recipes.groupBy("block", "leaf").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), hashed("doc_id", "row_id"))
    return leaves.groupBy("block").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), hashed("leaf"))


def _block_starts(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """(block, block_start), after all blocks, the totals and the store's root were held against the manifest; as many rows as blocks, on the driver."""
    told = sorted(tuple(r) for r in spark.read.parquet(f"{path}/manifest").select("block", "n_docs", "n_tokens", "start", "root").collect())
    lines, start = [], 0
    for block, n_docs, n_tokens, root in sorted(_block_roots(recipes).collect()):
        lines.append((block, n_docs, n_tokens, start, root))
        start += n_tokens
    top = hashlib.sha256(b"".join(bytes(x[4]) for x in lines)).digest()
    if told != [(-1, sum(x[1] for x in lines), start, 0, bytearray(top)), *lines]:
        raise ValueError("blocks, totals or roots do not match the manifest")
    return spark.createDataFrame([(x[0], x[3]) for x in lines], "block int, block_start long")


def _hold(doc_id, n_tokens: int, root: bytes, seqs: list[int], digests: list[bytes], sizes: list[int]) -> None:
    """A document's parts against its recipe."""
    whole = None not in digests and seqs == list(range(len(seqs)))
    if not whole or hashlib.sha256(b"".join(digests)).digest() != root or sum(sizes) != n_tokens:
        raise ValueError(f"document {doc_id} does not match its recipe")


def _checked(digest: bytes, n: int, payload: bytes | None) -> np.ndarray:
    """The ids of a chunk, held against its digest and their number."""
    if payload is None:
        raise ValueError(f"chunk {digest.hex()} is missing")
    if hashlib.sha256(payload).digest() != digest or len(ids := unpack(payload)) != n:
        raise ValueError(f"chunk {digest.hex()} is damaged")
    return ids


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, n_ids int, payload binary, kind string").parquet(f"{path}/pieces").filter("kind = 'chunk'").drop("kind")


def read_checksums(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone.

    Every chunk is read and held against its digest; a document's checksum joins its chunks' checksums, so that payloads are read
    where they lie and not shuffled. Recipes are held against their roots; blocks, totals and the store's root against the manifest, when this is
    called. A chunk or a block that is missing, or differs from its digest or root, is an error.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [zlib.crc32(_checked(*x).tobytes()) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64())], names=["digest", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, end = [], 0
            seqs, digests, sizes, sums = (c.to_pylist() for c in batch.column(4).flatten().flatten())  # of all documents' parts: plain lists, no dict a part
            for doc_id, n, root, n_parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(4).value_lengths().to_pylist(), strict=True):
                of = slice(end, end := end + n_parts)
                _hold(doc_id, n, root, seqs[of], digests[of], sizes[of])
                if None in sums[of]:
                    raise ValueError(f"chunk {digests[of][sums[of].index(None)].hex()} is missing")
                crcs.append(crc_join([(c, 4 * k) for c, k in zip(sums[of], sizes[of], strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "row_id", "n_tokens", "ids_crc32"])

    recipes = _recipes(spark, path, id_type)
    blocks = _block_starts(spark, path, recipes)
    before = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1))
    starts = recipes.select("block", "doc_id", "row_id", F.coalesce(before, F.lit(0)).alias("before"))
    starts = starts.join(F.broadcast(blocks), "block").select("row_id", (F.col("block_start") + F.col("before")).alias("start"))

    crcs = _chunks(spark, path).mapInArrow(check, "digest binary, crc long")
    parts = recipes.select("doc_id", "row_id", "n_tokens", "root", F.explode_outer("chunks").alias("c")).select("doc_id", "row_id", "n_tokens", "root", "c.*").join(crcs, "digest", "left")
    whole = parts.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("seq", "digest", "n_ids", "crc"))).alias("parts"))
    sums = whole.select("doc_id", "row_id", "n_tokens", "root", "parts").mapInArrow(join, f"doc_id {id_type}, row_id long, n_tokens long, ids_crc32 long")
    return sums.join(starts, "row_id").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, wanted: DataFrame | None = None, id_type: str = "bigint") -> DataFrame:
    """(doc_id, ids): documents' ids (array<long>) rebuilt from chunks; of those in wanted (doc_id), if given. Payloads are shuffled to their documents.

    Chunks, recipes, blocks and the manifest are held against each other as in read_checksums().
    """

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for doc_id, n, root, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _hold(doc_id, n, root, *([p[k] for p in parts] for k in ("seq", "digest", "n_ids")))
                ids.append(np.concatenate([_checked(p["digest"], p["n_ids"], p["payload"]) for p in parts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    recipes = _recipes(spark, path, id_type)
    _block_starts(spark, path, recipes)
    if wanted is not None:
        recipes = recipes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = recipes.select("doc_id", "row_id", "n_tokens", "root", F.explode_outer("chunks").alias("c")).select("doc_id", "row_id", "n_tokens", "root", "c.*").join(_chunks(spark, path).drop("n_ids"), "digest", "left")
    whole = parts.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("seq", "digest", "n_ids", "payload"))).alias("parts"))
    return whole.select("doc_id", "n_tokens", "root", "parts").mapInArrow(rebuild, f"doc_id {id_type}, ids array<long>")


def store_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes a store (below the shared folder, if no path is given) and reads it back; see read_checksums()."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_store(docs, path, tokenizer, id_col, text)
    return read_checksums(spark, path, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("doc_id", id_col)

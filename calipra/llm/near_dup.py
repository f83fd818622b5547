"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calipra.llm.components import components
from calipra.llm.common import bound_batches, materialize

SHINGLE = 5
#: Linked: 100 * intersection >= 75 * union.
PERCENT = 75
#: Components of a signature, and of a band. A pair of just 0.75 shares no band once in 190,000 pairs: (1 - 0.75**4)**32.
SIGNATURE, BAND = 128, 4
#: Members that one task holds against a hub, about.
GROUP = 256
#: Bits of a document's bitmap for each of its shingles, at least, and bits of the smallest bitmap (powers of two).
BITS, LEAST_BITS = 8, 512
#: Bytes of bitmaps in a block of a bucket's members, about: a task holds two blocks at a time.
BLOCK_BYTES = 1 << 20
#: Pairs for each document that is still apart, about, up to which all of them are confirmed at once.
FEW = 16
#: Nearest ones are confirmed again if there was a link for so many documents at least.
GAIN = 20
#: Nearest partners that a block proposes for each document, where pairs are more than that.
NEAREST = 3
#: Words whose hashes a worker remembers, and shingles whose signatures are made at once.
CACHE_WORDS, CHUNK = 100_000, 1 << 14

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, 65, dtype=np.uint64) * _GOLD) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set of a text's k-word shingles as ascending 64-bit hashes; of fewer words, the hash of all; of none, empty.

    Bytes do: lower() of bytes changes A-Z alone, and split() parts them at blanks and U+0009 to U+000D alone.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    m = min(n, k)
    h = np.full(n - m + 1, np.uint64(m))
    for i in range(m):
        h = h + w[i : n - m + 1 + i] * _FACTORS[i]
    return np.unique(_mix(h))


def super_minhash(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """The SuperMinHash signature of each set (rows; all ones for an empty set), as step << 56 | 56 random bits.

    Each element has a random permutation of the m places: in step j it lays j + r on its j-th place, r below 1, and each place
    keeps the least. Steps run for all elements at once. As all that is laid in later steps is larger, a set is done after
    the first step that leaves it no place above that step; for a large set, that is step 0.
    """
    step = lambda i: np.uint64(i * int(_GOLD) % 2**64)
    sizes = np.array([len(s) for s in sets], np.int64)
    sig = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    if sizes.sum():
        h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        places = None
        for j in range(m):
            r = _mix(h + step(2 * j + 1)) >> np.uint64(8)
            k = ((_mix(h + step(2 * j + 2)) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64) + j
            if places is None:
                at = k
            else:
                rows = np.arange(len(h))
                at = places[rows, k].astype(np.int64)
                places[rows, k] = places[:, j]
            np.minimum.at(sig, owner * m + at, r | np.uint64(j) << np.uint64(56))
            going = (sig.reshape(-1, m).max(1) >> np.uint64(56)) > np.uint64(j)
            keep = going[owner]
            if not keep.any():
                break
            if places is None:
                # the first step's exchange of places 0 and k, for those who go on
                h, owner, k = h[keep], owner[keep], k[keep]
                places = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
                places[np.arange(len(h)), k] = 0
            elif not keep.all():
                h, owner, places = h[keep], owner[keep], places[keep]
    return sig.reshape(len(sets), m)


def bands(sig: np.ndarray, rows: int = BAND) -> np.ndarray:
    """A 64-bit bucket for each band of each signature; different bands have different buckets."""
    parts = sig.reshape(len(sig), -1, rows)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for i in range(rows):
        h = _mix(h ^ parts[:, :, i]) * _FACTORS[i]
    return h.view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A power of two of bits, BITS for each shingle of a set at least; each shingle flips one, by its hash.

    Bits in which two bitmaps of one length differ are no more than shingles that only one of the sets has. Both halves of a
    bitmap, one flipped by the other, are the bitmap of half the length.
    """
    n = max(LEAST_BITS, 1 << (BITS * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    odd = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, n, keys, buckets, size = [], [], [], [], 0

        def flush(sets=sets, buckets=buckets):
            if sets:
                buckets.extend(bands(super_minhash(sets)))
                sets.clear()

        for t in batch.column(1):
            s = shingles(t.as_py())
            n.append(len(s))
            keys.append(_set_key(s))
            sets.append(s)
            size += len(s)
            if size >= CHUNK:
                flush()
                size = 0
        flush()
        keys = np.array(keys, np.int64).reshape(-1, 2)
        flat = np.concatenate([b if k else b[:0] for b, k in zip(buckets, n, strict=True)]) if n else np.zeros(0, np.int64)
        ends = np.cumsum([0] + [len(b) if k else 0 for b, k in zip(buckets, n, strict=True)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists], names=["id", "n", "a", "b", "buckets"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, doc, text), a group's hub first: the documents that link with their hub. One text is held besides the hub's."""
    at, base = None, None
    for batch in batches:
        us, vs = [], []
        for hub, salt, doc, t in zip(*(batch.column(i) for i in range(4)), strict=True):
            hub, salt, doc = hub.as_py(), salt.as_py(), doc.as_py()
            if doc is None:
                at, base = (hub, salt), shingles(t.as_py())
                continue
            if (hub, salt) != at:
                raise ValueError(f"hub {hub} has no text")
            s = shingles(t.as_py())
            both = len(np.intersect1d(base, s, assume_unique=True))
            if 100 * both >= PERCENT * (len(base) + len(s) - both):
                us.append(doc)
                vs.append(hub)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (doc, hub), those that are links, as (u, v). Each document's text goes to its hub's group; hubs of many are split by salt."""
    many = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / GROUP).cast("int")
    pairs = pairs.join(many, "hub").withColumn("salt", F.pmod(F.xxhash64("doc"), salts).cast("int"))
    hubs = many.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    rows = pairs.join(texts, pairs["doc"] == texts["node"]).select("hub", "salt", "doc", "text")
    heads = hubs.join(texts, hubs["hub"] == texts["node"]).select("hub", "salt", F.lit(None).cast("long").alias("doc"), "text")
    both = rows.unionByName(heads).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc").asc_nulls_first())
    return both.mapInArrow(_verify, "u long, v long")


def _near(ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray, maps: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, places, distances): for each member i, later or longer ones of other components that may link with it, by bounds that lose no link.

    With N shingles in both sets together, a link needs 7 * intersection >= 3 * N; the intersection is at most half of N less
    the bits that differ, so a link's differ in N / 7 bits at most. Sides are 0 and 1 in two blocks that meet, and all the same in one.
    """
    words = np.array([len(m) // 8 for m in maps])
    two = sides.min() != sides.max()
    of = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    flat = {w: np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), w) for w, at in of.items()}
    for w, at in of.items():
        others = [(at, flat[w], True)]
        if 2 * w in of:  # sizes of links differ by a third at most, so their bitmaps by one length
            others.append((of[2 * w], flat[2 * w][:, :w] ^ flat[2 * w][:, w:], False))
        for there, m, same in others:
            for k, i in enumerate(at):
                js, rows = (there[k + 1 :], m[k + 1 :]) if same else (there, m)
                fits = (labels[js] != labels[i]) & (4 * sizes[js] >= 3 * sizes[i]) & (4 * sizes[i] >= 3 * sizes[js])
                if two:
                    fits &= sides[js] != sides[i]
                if fits.any():
                    js = js[fits]
                    bits = np.bitwise_count(rows[fits] ^ flat[w][k]).sum(1, dtype=np.int64)
                    near = 7 * bits <= sizes[js] + sizes[i]
                    if near.any():
                        yield i, js[near], bits[near]


def _compare(nearest: bool, few: int):
    """Over rows (bucket, lo, hi, side, node, n, c, bits), grouped by the first three: the pairs that bounds leave, with k 0; if nearest, and there are more than few a member, some for each member, with how many there are as k."""

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        side, node, n, c, bits = zip(*rows, strict=True)
        node = np.array(node, np.int64)
        c = np.array(c, np.int64)
        if (c == c[0]).all():
            return
        found = _near(node, np.array(n, np.int64), c, np.array(side), bits)
        if not nearest:
            for i, js, d in found:
                for j, x in zip(js.tolist(), d.tolist(), strict=True):
                    yield int(max(node[i], node[j])), int(min(node[i], node[j])), x, 0
            return
        every: list[tuple[int, int, int, int]] | None = []
        best: dict[int, list[tuple[int, int]]] = {}
        count: dict[int, int] = {}
        for i, js, d in found:
            if every is not None:
                every += [(int(max(node[i], node[j])), int(min(node[i], node[j])), x, 0) for j, x in zip(js.tolist(), d.tolist(), strict=True)]
                every = every if len(every) <= few * len(rows) else None
            for j, x in zip(js.tolist(), d.tolist(), strict=True):
                for p, q in ((i, j), (j, i)):
                    own = best.setdefault(p, [])
                    own.append((x, int(node[q])))
                    if len(own) > 4 * NEAREST:
                        own.sort()
                        del own[NEAREST:]
            count[i] = count.get(i, 0) + len(js)
        if every is not None:
            yield from every
            return
        for p, own in best.items():
            for k, (x, q) in enumerate(sorted(own)[:NEAREST]):
                yield int(node[p]), q, x, count.get(p, 0) if k == 0 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            out = list(zip(*pairs(rows), strict=True)) if len(rows) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc", "hub", "d", "k"])

        at, rows = None, []
        for batch in batches:
            for b, lo, hi, *row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (b, lo, hi) != at:
                    yield from flush(rows)
                    at, rows = (b, lo, hi), []
                rows.append(tuple(row))
        yield from flush(rows)

    return run


def _meet(members: DataFrame, nearest: bool) -> DataFrame:
    """(doc, hub, d, k) of members (bucket, node, n, c, bits) that share a bucket. Members of a large bucket are cut into blocks of bounded bytes, and each two blocks meet in a task of their own."""
    size = members.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("bits")) / BLOCK_BYTES).cast("int").alias("blocks"))
    rows = members.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("bucket", lo.alias("lo"), hi.alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "c", "bits")
    rows = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return rows.mapInArrow(_compare(nearest, FEW), "doc long, hub long, d long, k long")


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, a, b, text): those whose text has the set (a, b), with its bitmap."""
    for batch in batches:
        at, maps = [], []
        for i, (a, b, t) in enumerate(zip(*(batch.column(k) for k in (2, 3, 4)), strict=True)):
            s = shingles(t.as_py())
            if _set_key(s) == (a.as_py(), b.as_py()):
                at.append(i)
                maps.append(bitmap(s))
        take = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in (0, 1, 4)] + [pa.array(maps, pa.binary())], names=["node", "n", "text", "bits"])


def near_dup_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id reachable by links) and kept (whether that is the row's own id).

    Documents of equal sets become one node first. Nodes that share a band are candidates. Each bucket with members elects the
    one with most company, and each member is held against the best hub it has: one pair a node, and a group of copies becomes
    one component without all its pairs. What shares a bucket and is still in different components is compared by bitmaps,
    in blocks, under bounds that lose no link. While many pairs are left, only each node's nearest one is confirmed, so that
    groups grow together; when few are left, or confirming has found no more links, all are. Links are confirmed on full sets.

    Null or empty texts, and those of blanks alone, have no shingles and are linked with nothing. Rows with a null id are
    linked with nothing: component_id is null and kept is true. Rows with equal ids are taken as one document, linked with what
    any of their texts is linked with: they share a component and are kept, or not, together. Ids are of any type that has an order.
    An empty table gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sketches = materialize(d.mapInArrow(_sketch, f"id {kind}, n long, a long, b long, buckets array<long>"), "sketches")
    named = sketches.filter("id is not null and n > 0")
    # a node's number holds for this one table, which is written
    sets = named.groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    reps = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    # one row for each bucket of two members or more, and member
    in_bucket = reps.select("node", "n", F.explode("buckets").alias("bucket"))
    sizes = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(in_bucket.join(sizes, "bucket"), "members")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = materialize(members.join(company, "node").select("bucket", "node", "n", "company"), "candidates")
    asked = company.select("node").join(reps, "node").select("node", "n", "a", "b", "rep")
    rows = d.join(asked, d["id"] == asked["rep"]).dropDuplicates(["id", "node", "text"])
    texts = materialize(rows.select("node", "n", "a", "b", "text").mapInArrow(_chosen, "node long, n long, text string, bits binary"), "texts")

    # rows of one id with different texts hold their sets together
    several = named.groupBy("id").agg(F.countDistinct("a", "b").alias("k")).filter("k > 1").select("id")
    nodes = named.join(several, "id").select("id", "a", "b").distinct().join(reps.select("a", "b", "node"), ["a", "b"])
    first = nodes.groupBy("id").agg(F.min("node").alias("v"))
    links = materialize(nodes.join(first, "id").filter("node > v").select(F.col("node").alias("u"), "v"), "same-id")
    label = spark.createDataFrame([], "node long, component long") if links.isEmpty() else components(links)

    def confirm(pairs: DataFrame) -> int:
        """Confirms pairs and joins what they link; how many links there are among them."""
        nonlocal tried, links, label
        tried = tried.unionByName(pairs)
        new = materialize(_linked(pairs, texts), "links")
        found = new.count()
        if found:
            links = links.unionByName(new)
            label = components(links)
        return found

    def apart() -> DataFrame:
        """Members of buckets that hold more than one component, with their component c and the bucket's hub."""
        now = members.join(label, "node", "left").select("bucket", "node", "n", "company", F.coalesce("component", "node").alias("c"))
        several = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("company", (-F.col("node")).alias("r"), "c")).alias("hub")).filter("lo < hi")
        return now.join(several.select("bucket", "hub"), "bucket")

    tried = spark.createDataFrame([], "doc long, hub long")
    best = apart().filter(F.col("c") != F.col("hub.c")).groupBy("node").agg(F.max("hub").alias("hub"))
    pairs = materialize(best.select(F.col("node").alias("doc"), (-F.col("hub.r")).alias("hub")), "pairs")
    if not pairs.isEmpty():
        confirm(pairs)
        rows = materialize(apart().select("bucket", "node", "c").join(texts.select("node", "n", "bits").dropDuplicates(["node"]), "node"), "apart")
        while True:
            again = tried.union(tried.select("hub", "doc")).toDF("doc", "hub")
            near = materialize(_meet(rows, True), "nearest")
            if near.isEmpty():
                break
            near = near.groupBy("doc", "hub").agg(F.min("d").alias("d"), F.max("k").alias("k"))
            left, n_docs = near.agg(F.sum("k"), F.countDistinct("doc")).first()
            if not left:  # these are all pairs
                pairs = materialize(near.select("doc", "hub").join(again, ["doc", "hub"], "left_anti"), "pairs")
                if not pairs.isEmpty():
                    confirm(pairs)
                break
            one = near.join(again, ["doc", "hub"], "left_anti").groupBy("doc").agg(F.min(F.struct("d", "hub")).alias("x"))
            one = one.select(F.greatest("doc", "x.hub").alias("doc"), F.least("doc", "x.hub").alias("hub")).distinct()
            if left > FEW * n_docs and GAIN * confirm(materialize(one, "pairs")) >= n_docs:
                rows = materialize(apart().select("bucket", "node", "c").join(rows.select("node", "n", "bits").dropDuplicates(["node"]), "node"), "apart")
                continue
            again = tried.union(tried.select("hub", "doc")).toDF("doc", "hub")
            pairs = materialize(_meet(rows, False).select("doc", "hub").distinct().join(again, ["doc", "hub"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                confirm(pairs)
            break
    groups = reps.join(label, "node", "left").select("a", "b", "rep", F.coalesce("component", "node").alias("c"))
    least = groups.groupBy("c").agg(F.min("rep").alias("component"))
    out = sketches.join(groups.join(least, "c").select("a", "b", "component"), ["a", "b"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, less those that another document of their group stands for."""
    gone = materialize(near_dup_groups(docs, id_col, text).filter(~F.col("kept")).select(F.col(id_col)).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone[id_col], "left_anti")

"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calipra.llm.common import ascii_lower, materialize

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Words of a shingle, the token of the join.
SHINGLE = 5
#: A benchmark with so many bytes of text is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: What lies between words, A-Z being lower-cased before (fixed by the contract).
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _runs(w: Column, n: int) -> Column:
    """All runs of n words, each joined by blanks, in order of their places."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def _keys(w: Column) -> Column:
    """Words as 64-bit numbers."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _tokens(k: Column, n: int) -> Column:
    """The 64-bit number of each run of n words (given as numbers), in order of their places: the tokens of the join. What meets by them is compared word by word."""
    return F.when(F.size(k) >= n, F.transform(F.sequence(F.lit(0), F.size(k) - n), lambda i: F.xxhash64(*[F.get(k, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window, n): the different windows of each item as blank-joined words; n is their number of words."""
    w = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    runs = F.when(F.size("w") < window, F.array(F.array_join("w", " "))).otherwise(_runs(F.col("w"), window))
    return w.select("item", F.least(F.size("w"), F.lit(window)).alias("n"), F.explode(F.array_distinct(runs)).alias("window")).distinct()


def window_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, at, n, window): each place of a document (by row key) where a window of the benchmark occurs.

    Tokens are shingles of words. One pass over the documents counts the benchmark's shingles and writes nothing else: that is
    their order of rarity. As a window occurs only where all its shingles do, its rarest one is all the prefix that it needs, and
    a window with one that no document has occurs nowhere. A second pass joins the documents with these prefixes alone. Where one
    is found, the window must begin offset words before it: bounds of place and length drop what would begin before the document
    does or end after it; documents that met a prefix are read once more, and the window is compared word by word, in the
    document's own words. What is beyond broadcast_bytes, of the benchmark or of what met, is joined by a shuffle instead.
    """
    windows = item_windows(benchmark, item, item_text, window).select("window", "n").distinct()
    # windows of fewer words than a shingle have one token, of all their words
    size = F.least(F.col("n"), F.lit(shingle))
    own = windows.select("window", "n", size.alias("size"), _keys(F.split("window", " ")).alias("k"))
    by_size = F.coalesce(*[F.when(F.col("size") == n, _tokens(F.col("k"), n)) for n in range(1, shingle + 1)])
    tokens = materialize(own.select("window", "n", "size", F.posexplode(by_size).alias("offset", "token")), "window-tokens")
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect())  # at most as many as a shingle has words
    d = docs.select(_key(F.col(id_col), F.col(text)).alias("key"), words(F.col(text)).alias("w"))
    if not sizes:
        return d.select("key", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("window")).limit(0)
    # prefixes are sent with their windows' texts, and no window has more than one
    n_bytes = tokens.select("window").distinct().agg(F.sum(F.octet_length("window") + 64)).first()[0]
    small = n_bytes <= broadcast_bytes
    sent = (lambda x: F.broadcast(x)) if small else (lambda x: x)

    def places(*cols: str) -> DataFrame:
        """at and token of all runs of words of the sizes asked for, from one pass."""
        each = d.select("key", _keys(F.col("w")).alias("k"))
        if len(sizes) == 1:
            return each.select(*cols, F.posexplode(_tokens(F.col("k"), sizes[0])).alias("at", "token"))
        all_sizes = F.concat(*[F.transform(_tokens(F.col("k"), n), lambda t, i: F.struct(i.alias("at"), t.alias("token"))) for n in sizes])
        return each.select(*cols, F.explode(all_sizes).alias("x")).select(*cols, "x.at", "x.token")

    vocabulary = tokens.select("token").distinct()
    rarity = materialize(places("key").join(sent(vocabulary), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("rows")), "rarity")
    ranked = tokens.join(rarity, "token").groupBy("window", "n", "size").agg(F.count(F.lit(1)).alias("present"), F.min(F.struct("rows", "offset", "token")).alias("first"))
    prefix = ranked.filter(F.col("present") == F.col("n") - F.col("size") + 1).select("window", "n", F.col("first.token").alias("token"), F.col("first.offset").alias("offset"))
    start = F.col("at") - F.col("offset")
    met = places("key").join(sent(prefix), "token").select("key", "window", "n", start.alias("start")).filter("start >= 0").distinct()
    met = met.groupBy("key").agg(F.collect_list(F.struct("start", "n", "window")).alias("met"))
    met = materialize(met.select(F.col("key").alias("met_key"), "met"), "met-prefixes")
    n_bytes = met.agg(F.coalesce(F.sum(F.aggregate("met", F.lit(64), lambda n, x: n + F.octet_length(x["window"]) + 16)), F.lit(0))).first()[0]
    keyed = docs.select(_key(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text"))
    rows = keyed.join(F.broadcast(met) if n_bytes <= broadcast_bytes else met, F.col("key") == F.col("met_key")).dropDuplicates(["key"])
    same = lambda w, m: (m["start"] + m["n"] <= F.size(w)) & (F.array_join(F.slice(w, m["start"] + 1, m["n"]), " ") == m["window"])
    hits = F.transform(F.array(words(F.col("text"))), lambda w: F.filter("met", lambda m: same(w, m)))[0]
    return rows.select("key", F.explode(hits).alias("m")).select("key", F.col("m.start").alias("at"), "m.n", "m.window")


def _key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text: equal rows share their hits."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated; see report() for rows with all their columns.

    A word inside any occurrence of a window is hit once, however many windows hold it. Null and empty texts, and texts without
    words, have no words and no hits; items without words have no windows; equal items each count. Equal rows have equal results.
    """
    hits = materialize(window_hits(docs, benchmark, id_col, text, item, item_text, window, broadcast_bytes=broadcast_bytes), "hits")
    items = item_windows(benchmark, item, item_text, window).select(F.col("item").cast("string").alias("item"), "window").distinct()
    named = hits.select("key", "window").distinct().join(items, "window").groupBy("key").agg(F.collect_set("item").alias("items"))
    # union of intervals: sorted by start, each adds what it has beyond the farthest end so far
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grow = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["at"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    hit = spans.select("key", F.aggregate("spans", zero, grow)["n"].alias("n_hit"))
    by_key = hit.join(named, "key").withColumnRenamed("key", "hit_key")
    n_words = F.size(words(F.col(text))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), _key(F.col(id_col), F.col(text)).alias("key"), n_words.alias("n_words"))
    none = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(by_key, F.col("key") == F.col("hit_key"), "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(none).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(none), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all columns, in which no window of the benchmark occurs."""
    hits = materialize(window_hits(docs, benchmark, id_col, text, window=window).select("key").distinct(), "hit-rows")
    return docs.join(hits, _key(F.col(id_col), F.col(text)) == hits["key"], "left_anti")

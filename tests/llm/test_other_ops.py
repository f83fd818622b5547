"""URL filters, toxicity, token store, WARC, sharding and top-k against plain versions, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calipra.llm import token_store, toxicity, warc
from calipra.llm.queries import ORACLE_SQL, QUERIES
from calipra.llm.sharding import _draw, communication_matrix, shard_rows, shard_sizes, write_shards
from calipra.llm.token_store import Encoder, crc_join, cuts, read_checksums, read_ids, store_round_trip, write_store
from calipra.llm.topk import top_k
from calipra.llm.url_filter import Rules, UrlModel, judge_urls, labelled_sample, parts, rule_model
from calipra.llm.warc import chunked, parse_archive, payload_of, read_warc, unchunked, warc_round_trip, write_warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


# URL filters


def test_url_parts_and_rules():
    assert parts("HTTP://A.Example.NET:80/en/x?q#f") == ("a.example.net:80", "/en/x")
    assert parts("http://x.org?a/b") == ("x.org", "") and parts("http://x.org#a") == ("x.org", "")
    assert parts("no scheme") == parts(None) == parts("") == ("", "")
    r = Rules()
    assert r.match("a.net", "/x") == ("net/", "block") and r.match("b.example.net", "/en/1") == ("example.net/en/", "allow")
    assert r.match("example.com", "/de/") == ("example.com/de/", "block") and r.match("x.org", "/fr/a") == ("org/fr/", "allow")
    assert r.match("xnet", "/") is None and r.match("net.com", "/") is None and r.match("a.net", "") is None and r.match("", "") is None


def test_url_model_learns_lexical_features():
    """Labels that go with depth, digits and suffix are learned from examples and hold for others; without examples, nothing is."""
    r = random.Random(6)

    def url(y):
        host = "".join(r.choice("abcdefgh") for _ in range(8)) + (str(r.randint(10, 9999)) if y else "")
        return f"http://{host}.{r.choice(['biz', 'com'] if y else ['edu', 'com'])}/" + "/".join("p%d" % r.randint(0, 9) for _ in range(r.randint(2, 5) if y else r.randint(0, 2)))

    rows = [(url(i % 2), i % 2) for i in range(1600)]
    model = UrlModel(rows[:1200])
    right = np.mean((model.scores([u for u, _ in rows[1200:]]) >= 0.5) == [y for _, y in rows[1200:]])
    assert right > 0.9 and set(model.rate) == {"biz", "com", "edu"} and set(UrlModel(rows[:1200], frozenset({"biz"})).rate) == {"com", "edu"}
    assert (UrlModel([]).scores(["http://a.b/c", None]) == 0.5).all()


def _plain_judgement(url):
    """Host, path and rule, from the contract's words."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_url_query_on_all_pages(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op3_url_filter"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, best = _plain_judgement(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "block" if r.score >= 0.5 else "allow")


def test_judge_urls(spark):
    rows = [(1, "http://a.net/x", "h"), (2, None, None), (3, "", "h"), (3, "", "h"), (None, "https://x.org/fr/1", "h"), (5, "http://cheap-pills.example.com/en/1", "h"), (6, "http://" + "a" * 100_000, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    model = rule_model(df)
    got = judge_urls(df, model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].rule == "net/" and by[1].verdict == "block" and by[None].verdict == "allow" and by[2].rule is None and by[2].host == ""
    assert by[5].verdict == ("block" if by[5].score >= 0.5 else "allow") and by[5].rule is None
    assert judge_urls(df.limit(0), model).count() == 0
    labelled = spark.createDataFrame([(f"http://a{i}.com", i % 2) for i in range(50)] + [(None, 1), ("x", None)], "url string, label int")
    assert len(labelled_sample(labelled, limit=20)) == 20 and labelled_sample(labelled.repartition(7), limit=20) == labelled_sample(labelled, limit=20)


# toxicity


def _near(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_levenshtein():
    terms = {"stupid": 1.0, "idiot": 2.0, "scum": 3.0, "clown": 4.0}
    for errors in (1, 2):
        auto = toxicity.Automaton(toxicity.Trie(terms), errors)
        r = random.Random(errors)
        for _ in range(2000):
            w = list(r.choice(list(terms)))
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = r.choice(["", "x", "i", "s"])
            w = "".join(w)
            assert auto.weight(w) == max([x for t, x in terms.items() if _near(w, t) <= errors], default=0.0), w


def _labelled(n, seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "ba", "mi", "tu") for b in ("ra", "ne", "so", "ki")]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(10, 60))]
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idiot", "moron", "scumbag"])
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity_learns(spark, odd, none):
    rows = _labelled(800, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9999, 1, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    truth = {i: y for i, _, y in rows}
    got = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    odd_scores = toxicity.score_toxicity(odd, model)
    assert odd_scores.count() == odd.count() and odd_scores.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(none, model).count() == 0
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(1 for r in got if not r.predicted)
    assert toxicity.drop_toxic(odd, model).count() <= odd.count()
    no_labels = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, no_labels).agg(F.countDistinct("score")).first()[0] == 1


def test_misspelled_terms_and_quotations():
    rows = [(t, y) for _, t, y in _labelled(600, 3)]
    lexicon = toxicity.ToxicityModel(rows).lexicon
    assert lexicon.found("idiot")[0] > 0 and lexicon.found("idiiot")[2] > 0 and lexicon.found("lora") is None
    plain, quoted = toxicity.features(lexicon, "you idiot lora"), toxicity.features(lexicon, 'lora "idiot" lora')
    assert plain[-1] > 0 and quoted[-1] == 0  # the last feature is what stands outside of quotations


# token store


def test_crc_join():
    r = random.Random(1)
    for _ in range(50):
        parts_ = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 4, 100]))) for _ in range(r.randint(0, 5))]
        assert crc_join([(zlib.crc32(p), len(p)) for p in parts_]) == zlib.crc32(b"".join(parts_))


def test_cuts_follow_content():
    r = np.random.default_rng(1)
    a = r.integers(0, 50_000, 60_000).astype(np.uint32)
    ends = cuts(a)
    assert ends[-1] == len(a) and max(np.diff([0, *ends])) <= 4096 and min(np.diff([0, *ends])[:-1]) >= 64
    moved = cuts(np.concatenate([a[:5000], r.integers(0, 50_000, 7).astype(np.uint32), a[5000:]]))
    assert len({e - 7 for e in moved if e > 9100} & set(ends)) > 0.8 * len([e for e in ends if e > 9100])
    assert cuts(a[:1]) == [1] and cuts(np.zeros(10_000, np.uint32))[-1] == 10_000


def test_encoder_is_the_librarys():
    own, lib = Encoder(PATH), Tokenizer.from_file(PATH)
    assert own.plain
    for t in ("", "a<|endoftext|>b", " " * 5000 + "x", "'s don’t\t\n 日本語 é" * 20, "".join(map(chr, range(32, 0x2000))), "y" * 20_000):
        assert own(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def _plain_store(rows):
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_of_a_whole_table(spark):
    """The query against the library, over all documents."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op7_token_store"](spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(_plain_store(rows))


def test_store_round_trip(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "LEAF", 2)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, store_round_trip(odd, PATH, path=f"file://{tmp_path}/a").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == _plain_store(rows)
    back = {(r.doc_id, tuple(r.ids)) for r in read_ids(spark, f"file://{tmp_path}/a").collect()}
    lib = Tokenizer.from_file(PATH)
    assert back == {(i, (*lib.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows}
    digests = spark.read.parquet(f"file://{tmp_path}/a/pieces").filter("kind = 'chunk'").groupBy("digest").count()
    assert digests.filter("count > 1").count() == 0
    assert store_round_trip(none, PATH, path=f"file://{tmp_path}/b").count() == 0


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    write_store(spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(20)], "doc_id long, text string"), path, PATH)
    manifest = spark.read.parquet(f"{path}/manifest").withColumn("root", F.unhex(F.lit("00"))).collect()
    spark.createDataFrame(manifest, "block int, n_docs long, n_tokens long, start long, root binary").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="manifest"):
        read_checksums(spark, path).collect()


def test_missing_and_damaged_pieces_are_errors(spark, tmp_path):
    path, chunk = f"file://{tmp_path}/s", "digest binary, n_ids int, payload binary"
    write_store(spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(20)], "doc_id long, text string"), path, PATH)
    read = lambda name, *cols: spark.read.parquet(f"{path}/{name}").select(*(cols or "*"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}")

    chunks = read("pieces/kind=chunk", "digest", "n_ids", "payload").collect()
    put(chunks[1:], chunk, "pieces/kind=chunk")  # the only chunk of a document
    for f in (read_checksums, read_ids):
        with pytest.raises(Exception, match="is missing"):
            f(spark, path).collect()
    put([(chunks[0].digest, chunks[0].n_ids, chunks[0].payload[:-1] + b"\xff"), *chunks[1:]], chunk, "pieces/kind=chunk")
    with pytest.raises(Exception, match="is damaged"):
        read_ids(spark, path).collect()
    put(chunks, chunk, "pieces/kind=chunk")
    assert read_checksums(spark, path).count() == read_ids(spark, path).count() == 20

    manifest = read("manifest")
    rows, schema = manifest.collect(), manifest.schema
    for change in ({"root": bytearray(32)}, {"n_docs": 21}, {"n_tokens": 1}):
        put([tuple((r.asDict() | (change if r.block == -1 else {})).values()) for r in rows], schema, "manifest")
        with pytest.raises(Exception, match="manifest"):
            read_checksums(spark, path).collect()
    put(rows, schema, "manifest")
    recipes = read("recipes")
    put([r for r in recipes.collect() if r.block != rows[0].block], recipes.schema, "recipes")
    for f in (read_checksums, read_ids):
        with pytest.raises(Exception, match="manifest"):
            f(spark, path).collect()


# WARC


def test_chunked_framing():
    for n in (0, 1, 8192, 20_000):
        assert unchunked(chunked(b"\r\n5" * n)) == b"\r\n5" * n
    assert unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    assert payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def _plain_warc(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        again = i is not None and f < i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark, tmp_path):
    big = "WARC/1.1\r\n\r\n" + "é" * 120_000
    rows = [(1, "u", "<p>a</p>"), (2, "u\r\nX: y", "<p>a</p>"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (5, "u", big), (None, "u", "<p>a</p>"), (7, "ü", "0\r\n\r\n"), (8, "u", "b" * 32_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "type": F.lit(2)})
    got = warc_round_trip(df.repartition(3), path=f"file://{tmp_path}/w")
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_warc([(i, h) for i, _, h in rows])
    assert warc_round_trip(df.limit(0), path=f"file://{tmp_path}/e").count() == 0
    heads = [h for f in spark.read.format("binaryFile").load(f"file://{tmp_path}/w").collect() for h, _ in parse_archive(bytes(f.content))]
    kinds = Counter(h["warc-type"] for h in heads)
    assert kinds["continuation"] > 3 and kinds["revisit"] == 3


def test_missing_segments_are_errors(spark, tmp_path):
    records = warc.records_of(1, "u", b"x" * 100_000, None, "r", "2024-01-01T00:00:00Z")
    assert len(records) > 2
    (tmp_path / "a.warc").write_bytes(b"".join(reversed(records)))
    assert read_warc(spark, f"file://{tmp_path}/a.warc").first().payload_bytes == 100_000
    (tmp_path / "b.warc").write_bytes(b"".join(records[:1] + records[2:]))
    with pytest.raises(Exception, match="missing"):
        read_warc(spark, f"file://{tmp_path}/b.warc").collect()


# sharding


def test_matrix_sums():
    blocks = [0, 5, 1000, 37, 2]
    m = communication_matrix(blocks, shard_sizes(sum(blocks), 8), 1)
    assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m, strict=True)] == shard_sizes(sum(blocks), 8)
    big = communication_matrix([10**10, 2 * 10**10], shard_sizes(3 * 10**10, 8), 1)
    assert [sum(r) for r in big] == [10**10, 2 * 10**10]


def test_draws_follow_the_exact_law():
    """Frequencies of small draws against binomial coefficients; mean and deviation of draws beyond 64-bit factorials."""
    rng = np.random.default_rng(3)
    for good, bad, n in ((7, 5, 6), (3, 40, 10), (30, 2, 20), (1, 0, 1), (0, 4, 2)):
        got = Counter(_draw(rng, good, bad, n) for _ in range(20_000))
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs(got[k] / 20_000 - p) < 0.015 and (p > 0 or not got[k])
    good, bad, n = 3 * 10**11, 10**12, 5 * 10**6
    x = np.array([_draw(rng, good, bad, n) for _ in range(2000)], float)
    p = good / (good + bad)
    sd = (n * p * (1 - p)) ** 0.5
    assert abs(x.mean() - n * p) < 0.1 * sd and 0.93 < x.std() / sd < 1.07


def test_many_equal_rows_are_dealt_in_pieces(spark):
    rows = [(1, "same")] * 5000 + [(i, str(i)) for i in range(2, 500)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.copy for r in got if r.doc_id == 1) == list(range(5000))
    for s, size in enumerate(shard_sizes(len(rows), 8)):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(size))


def test_shards_are_exact_and_uniform(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 13_000, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = shard_rows(df, block_rows=3000).toPandas()
    assert sorted(got.doc_id) == list(range(40_000)) and set(got.groupby("shard").size()) == {5000}
    assert all(sorted(g.slot) == list(range(5000)) for _, g in got.groupby("shard"))
    means = got.groupby("shard").doc_id.mean()
    assert abs(means - 20_000).max() < 6 * 11_547 / 5000**0.5
    corr = np.corrcoef(got.doc_id, got.slot)[0, 1]
    assert abs(corr) < 0.03
    again = shard_rows(df.repartition(9), block_rows=3000).toPandas()
    assert dict(zip(got.doc_id, zip(got.shard, got.slot, strict=True), strict=True)) == dict(zip(again.doc_id, zip(again.shard, again.slot, strict=True), strict=True))


def test_shards_odd_rows(spark, odd, none, tmp_path):
    got = shard_rows(odd, shards=3).collect()
    assert len(got) == odd.count() and max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    assert shard_rows(none).count() == 0
    write_shards(odd, f"file://{tmp_path}/s", shards=3)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == odd.count()


# top-k


def _plain_top_k(rows, k):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out, done = [], set()
    for q, v in ok:
        if q % 10 == 0 and (q, tuple(v)) not in done:
            done.add((q, tuple(v)))
            s = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def test_top_k_is_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [1.0, 0.5, 0.25, 0.0, -1.0, 2.0]) for i in range(60)]
    rows += [(301, None), (310, [None] * 6), (320, [float("nan")] * 6), (331, [float("inf")] * 6), (None, [1.0] * 6), (340, []), (350, [1.0, 2.0]), (351, [3.0, 1.0]), (352, [3.0, 1.0]), (352, [3.0, 1.0]), (20, rows[20][1]), (360, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"key": F.lit(1), "lo": F.lit("x"), "cb": F.lit(2), "dim": F.lit(0)})
    got = top_k(df.repartition(4), F.col("vec_id") % 10 == 0, 10, query_bytes=300)
    assert sorted(map(tuple, got.collect())) == _plain_top_k(rows, 10)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Products beyond a double's integers are exact; those that a long could not hold are an error."""
    rows = [(i, [30_000.0 + i, -20_000.5 * i, 40_000.0 * (i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 10 == 0).collect())) == _plain_top_k(rows, 10)
    with pytest.raises(ValueError, match="large"):
        top_k(spark.createDataFrame([(0, [3e38]), (1, [3e38])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)


def test_the_querys_rows_are_the_sqls(spark):
    """The queries with SQL, on the driver's smallest tables."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df, want = QUERIES[name](spark, sf), con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        names = sorted(df.columns)
        at = [want.columns.index(c) for c in names]
        assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())

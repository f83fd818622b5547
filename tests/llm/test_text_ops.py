"""BPE, line dedup, decontamination and near-dedup against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calipra.llm.bpe import WORDS, bpe_round_trip, load, split_words
from calipra.llm.components import components
from calipra.llm.decontam import decontaminate, drop_contaminated
from calipra.llm.line_dedup import host_of, line_dedup
from calipra.llm import near_dup
from calipra.llm.near_dup import drop_near_dups, near_dup_groups, shingles, super_minhash

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab '’\n\t019é日<|endoftext|>", max_size=80))
def test_bpe_is_the_librarys(text):
    bpe, lib = load(PATH), _library()
    packed = bpe.encode(text)
    assert array("I", packed).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert bpe.decode(packed) == lib.decode(array("I", packed).tolist(), skip_special_tokens=False)


def test_words_are_the_patterns():
    """Each character, and each two of different kinds, are split as the vocabulary's pattern does."""
    find = regex.compile(WORDS).findall
    assert all(split_words(t) == find(t) for c in range(0x250) for t in (chr(c), f"a{chr(c)}b", f"1{chr(c)}2", f" {chr(c)} {chr(c)}!", f"_{chr(c)}'s\n{chr(c)}\n\n"))
    assert all(split_words(t) == find(t) for t in ("日本 ½ x", "a\x1cb", "it's I'll  \n", "²³ a", "\u2028x"))


def _library():
    if not hasattr(_library, "t"):
        _library.t = Tokenizer.from_file(PATH)
    return _library.t


def test_bpe_odd_rows(odd, none):
    lib = _library()
    rows = bpe_round_trip(odd, PATH, with_ids=True).collect()
    assert len(rows) == odd.count()
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    for r in rows:
        assert texts[r.doc_id, r.decoded] > 0
        ids = lib.encode(r.decoded, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe_round_trip(none, PATH).count() == 0


def _plain_line_dedup(rows, ratio, least):
    n_host, n = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            n[h, x] += 1
    out = []
    for i, h, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        full = [x for x in lines if x.strip(" ")]
        bad = lambda x, h=h: x.strip(" ") and n[h, x.strip(" ")] >= least and n[h, x.strip(" ")] > ratio * n_host[h]
        k = sum(1 for x in full if bad(x))
        out.append((i, "\n".join(x for x in lines if not bad(x)) if k else t, len(full), k))
    return out


@pytest.mark.parametrize("limit", [50_000, 0])
def test_line_dedup_is_the_plain_version(spark, limit):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "b", None]), "\n".join(r.choice(["menu", " menu ", "foot", "", "x%d" % r.randint(0, 30)]) for _ in range(r.randint(0, 6)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = line_dedup(df, max_ratio=0.2, min_pages=3, broadcast_lines=limit)
    want = _plain_line_dedup(rows, 0.2, 3)
    assert sorted((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()) == sorted(want)
    assert any(x[3] for x in want)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_line_dedup_odd_rows(odd, none, limit):
    got = line_dedup(odd, max_ratio=0.1, min_pages=2, broadcast_lines=limit)
    assert set(got.columns) == set(odd.columns) | {"n_dropped"}
    assert got.count() == odd.count()
    copies = [x for x in got.collect() if x.doc_id in (1, 7)]
    assert len(copies) == 3 and all((x.text, x.n_dropped) == ("", 2) for x in copies)  # nothing but boilerplate
    assert line_dedup(none).count() == 0


def test_line_dedup_by_host(spark):
    """The site of a page is the host of its url."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, re.match("(?s)(?:.*?://([^/?#]*))?", r.url or "")[1], r.html) for r in pages.collect()]
    rows = [(i, (h or "").lower() if u is not None else None, t) for (i, h, t), u in zip(rows, [r.url for r in pages.collect()], strict=True)]
    got = line_dedup(pages.withColumn("host", host_of(F.col("url"))), "host", "html", 0.2, 2)
    assert sorted((x.page_id, x.html, x.n_lines, x.n_dropped) for x in got.collect()) == sorted(_plain_line_dedup(rows, 0.2, 2))


_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def _plain_decontaminate(docs, items, window=10):
    w = lambda t: _WORD.findall((t or "").translate(_LOW))
    windows = defaultdict(set)
    for i, t in items:
        x = w(t)
        n = min(len(x), window)
        if n:
            for k in range(len(x) - n + 1):
                windows[tuple(x[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        x, hit, own = w(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(x) - n + 1):
                if (q := tuple(x[k : k + n])) in windows:
                    own |= windows[q]
                    hit |= set(range(k, k + n))
        out.append((i, len(x), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decontamination_is_the_plain_version(spark, limit):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(["Aa", "bb", "cc-dd", "é", "9x"]) for _ in range(n))
    items = [(i, text(r.randint(0, 16))) for i in range(12)] + [(90, "Ünique Ä words"), (91, None), (92, "bb"), (9, "same"), (10, "same")]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(70, "x Ünique ä words Ünique Ä words"), (71, None), (72, ""), (73, "SAME same"), (None, items[5][1]), (74, " ".join(t or "" for _, t in items))]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate(d, b, broadcast_bytes=limit).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(_plain_decontaminate(docs, items), key=key)


def test_decontamination_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog shared line of text"), (None, None)], "item_id int, text string")
    got = decontaminate(odd, b)
    assert got.count() == odd.count()
    assert {r.doc_id for r in got.collect() if r.contaminated} == {1, 7}
    assert decontaminate(none, b).count() == 0
    assert decontaminate(odd, b.limit(0)).filter("contaminated").count() == 0
    left = drop_contaminated(odd, b)
    assert left.columns == odd.columns and left.count() == odd.count() - 3


def _plain_groups(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i), root(i) == i) for i in ids]


def test_near_dups_are_the_plain_version(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(3, 160))] for _ in range(25)]
    docs = []
    for k in range(260):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((k, " ".join(w)))
    # a chain whose ends are not linked themselves
    chain = [f"c{i}" for i in range(100)]
    docs += [(300 + k, " ".join(chain[8 * k : 8 * k + 60])) for k in range(5)]
    docs += [(400, ""), (401, None), (402, " \t"), (403, "A b"), (404, "a  B\n"), (405, "a c")]
    got = near_dup_groups(spark.createDataFrame(docs, "doc_id int, text string").repartition(5))
    assert sorted(map(tuple, got.collect())) == _plain_groups(docs)


def _long_docs(r, words=2000, copies=14):
    """Texts of some thousand words, each with some runs of words changed, so that pairs are at 0.68 to 0.85."""
    vocabulary = [f"v{i}" for i in range(5000)]
    out, base = [], [r.choice(vocabulary) for _ in range(words)]
    for k in range(copies):
        w = list(base)
        for _ in range(r.randint(20, 45)):
            w[r.randrange(words)] = r.choice(vocabulary)
        out.append((1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize(("block", "few"), [(1 << 20, 16), (2048, 0)])
def test_near_dups_of_long_texts(spark, monkeypatch, block, few):
    """Blocks of a bucket that meet in tasks of their own, and groups that grow by nearest pairs, find the same links."""
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", block)
    monkeypatch.setattr(near_dup, "FEW", few)
    r = random.Random(4)
    docs = _long_docs(r) + [(2000 + k, t) for k, (_, t) in enumerate(_long_docs(r, 160, 60))]
    a = [f"a22730x{i}" for i in range(704)]  # at exactly 0.75, with signatures that agree in 78 of 128 places
    docs += [(1, " ".join(a)), (2, " ".join(a[:604] + [f"b22730x{i}" for i in range(100)]))]
    got = near_dup_groups(spark.createDataFrame(docs, "doc_id int, text string"))
    want = _plain_groups(docs)
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for *_, c, _ in want}) > 5


def test_bitmaps_lose_no_link_and_spare_a_hot_bucket():
    """Bits that differ are no more than shingles that only one set has; members of one template that aren't linked make no pairs."""
    r = random.Random(9)
    sets = [shingles(" ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(1, 900)))) for _ in range(40)]
    for a in sets:
        for b in sets[:10]:
            x, y = np.frombuffer(near_dup.bitmap(a), np.uint64), np.frombuffer(near_dup.bitmap(b), np.uint64)
            while len(x) != len(y):
                x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    template = [f"t{i}" for i in range(180)]
    pages = [shingles(" ".join(template + [f"p{k}x{i}" for i in range(120)])) for k in range(150)]
    n = len(pages)
    ids = np.arange(n)
    assert not list(near_dup._near(ids, np.array([len(s) for s in pages]), ids, np.zeros(n), [near_dup.bitmap(s) for s in pages]))


def test_near_dups_of_repeated_and_other_ids(spark):
    """Each text of an id is compared; ids may be strings."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " y"), (9, "z")]
    got = near_dup_groups(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted(map(tuple, got.select("doc_id", "component_id", "kept").collect())) == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]
    named = spark.createDataFrame([(f"id{i}", t) for i, t in rows], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dup_groups(named).collect()) == [("id5", "id5"), ("id5", "id5"), ("id7", "id5"), ("id8", "id5"), ("id9", "id9")]
    assert sorted(r.doc_id for r in drop_near_dups(named).collect()) == ["id5", "id5", "id9"]


def test_near_dups_odd_rows(odd, none):
    got = near_dup_groups(odd)
    assert got.count() == odd.count()
    by = defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[7] == {(1, False)} and by[2] == {(2, True)} and by[None] == {(None, True)}
    left = drop_near_dups(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.select("doc_id").collect()} == set(by) - {7}
    assert near_dup_groups(none).count() == 0


def test_super_minhash_is_the_sequential_algorithm():
    """Each element walks its own permutation; the vectorised steps stop early, and must lay the same values."""
    m, top = 32, 2**64

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % top
        return x ^ (x >> 31)

    sets = [shingles(" ".join(f"x{i % (7 + k)}" for i in range(k))) for k in (1, 4, 9, 60, 300)] + [shingles("")]
    sig = super_minhash(sets, m)
    for s, got in zip(sets[:-1], sig, strict=False):
        h = [top - 1] * m
        for e in map(int, s):
            p = list(range(m))
            for j in range(m):
                k = j + ((mix((e + (2 * j + 2) * 0x9E3779B97F4A7C15) % top) >> 32) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], mix((e + (2 * j + 1) * 0x9E3779B97F4A7C15) % top) >> 8 | j << 56)
        assert h == list(map(int, got))
    assert (sig[-1] == np.iinfo(np.uint64).max).all()


def test_signatures_estimate_similarity():
    a, b = shingles(" ".join(f"a{i}" for i in range(404))), shingles(" ".join(f"a{i}" for i in range(100, 504)))
    sig = super_minhash([a, b], 128)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12


@pytest.mark.parametrize("links", [500_000, 4])
def test_components(spark, monkeypatch, links):
    """One task's union-find and the star contractions over many find the same."""
    import calipra.llm.components as c

    monkeypatch.setattr(c, "LINKS", links)
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(up) if root(x) != x}



def test_named_characters_split_as_the_library_does():
    from calipra.llm import bpe

    kinds = [f(chr(i)) for i in range(0x250) for f in (lambda c: c, lambda c: " " + c, lambda c: "a" + c + "1", lambda c: c + c + "x", lambda c: "'" + c)]
    assert all(bpe._LATIN_WORDS(t) == bpe._ALL_WORDS(t) for t in [*kinds, "it's 's 'll''ve  \n x", "a  b \t\x1c\x85\xa0 c"])
    assert not bpe._OTHER("x\u00b2 \x1c")  # these went the slower way before

"""The pipeline's stages, each on its own input, against plain versions of what they decide."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from calipra.llm.queries import ORACLE_SQL, QUERIES


def _tables(spark, path):
    """Documents with toxic ones, lines of a frame, near copies and benchmark passages; and labels and items."""
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("lo", "ba", "mi", "tu") for b in ("ra", "ne", "so", "ki") for c in ("n", "s", "l", "")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = text(30)
    rows, labels, kind = [], [], {}
    for i in range(400):
        t = text(r.randint(40, 80))
        kind[i] = "clean"
        if i % 5 == 0:
            t, kind[i] = t + " idiot moron scumbag " + t[:40] + " idiot", "toxic"
        elif i % 41 == 1:
            t, kind[i] = t + " " + item, "leak"
        elif i % 23 == 2 and kind.get(i - 1) == "clean":
            t, kind[i] = rows[-1][1].removesuffix("\nsite menu of all pages") + " more", "copy"
        rows.append((i, t + ("\nsite menu of all pages" if i % 2 else ""), "en", "src", len(t)))
        labels.append((i, 1, int(kind[i] == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {i: (t, kind[i]) for i, t, *_ in rows}


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = _tables(spark, path)
    stages, df = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}

    kept = stages["toxicity"](spark, df, path)
    assert kept.columns == corpus_pipeline.COLUMNS and ids(kept) == {i for i, (_, k) in docs.items() if k != "toxic"}
    lined = stages["line dedup"](spark, kept, path)
    assert ids(lined) == ids(kept) and lined.filter("text like '%site menu%' or n_chars <> length(text)").count() == 0
    single = stages["near-dedup"](spark, lined, path)
    assert ids(lined) - ids(single) == {i for i, (_, k) in docs.items() if k == "copy"}
    clean = stages["decontamination"](spark, single, path)
    assert ids(single) - ids(clean) == {i for i in ids(single) if docs[i][1] == "leak"}
    out = {r.doc_id: r for r in stages["bpe"](spark, clean, path).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {i: (r.n_tokens, r.decoded_sha256) for i, r in out.items()} == {i: (len(lib.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, path).collect()} == {tuple(r) for r in out.values()}


def test_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and other columns pass all stages; so do empty tables."""
    for name, docs in (("odd", odd), ("none", none)):
        path = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog shared line of text"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        if name == "none":
            assert not out
        else:  # 7 is a copy of 1, whose rows hold a benchmark's window
            assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd.collect() if r.doc_id not in (1, 7))
            assert all(r.n_tokens == 0 for r in out if r.doc_id in (2, 3))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5

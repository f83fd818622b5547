"""The queries of this subpackage: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calipra.llm.bpe import bpe_round_trip
from calipra.llm.decontam import decontaminate
from calipra.llm.line_dedup import MAX_RATIO, MIN_PAGES, line_dedup
from calipra.llm.near_dup import near_dup_groups
from calipra.llm.sharding import shard_rows
from calipra.llm.token_store import store_round_trip
from calipra.llm.topk import top_k
from calipra.llm.toxicity import fit, score_toxicity
from calipra.llm.url_filter import judge_urls, rule_model
from calipra.llm.warc import warc_round_trip

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return line_dedup(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return judge_urls(pages, rule_model(pages))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_groups(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_read(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_read(spark, sf_dir, "documents")).drop("copy")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_near_dup": op5_near_dup,
    "op6_toxicity": op6_toxicity,
    "op7_token_store": op7_token_store,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_top_k": op10_top_k,
}

ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
n_host AS (SELECT source, count(*) AS n_host FROM documents GROUP BY source),
bad AS (
  SELECT source, line FROM (
    SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, trim(line))
  JOIN n_host USING (source) WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * n_host),
told AS (
  SELECT l.doc_id, l.i, l.line, trim(l.line) <> '' AS full_line, b.line IS NOT NULL AS bad
  FROM lines l LEFT JOIN bad b ON l.source = b.source AND trim(l.line) = b.line),
per_doc AS (
  SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (full_line AND bad) AS n_bad,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS left_text
  FROM told GROUP BY doc_id)
SELECT d.doc_id, d.source,
  CASE WHEN n_bad > 0 THEN coalesce(left_text, '') ELSE d.text END AS text,
  CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
  CAST(coalesce(n_bad, 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id""",
    "op4_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r.doc_id, r.i, r.n, win.item_id FROM runs r JOIN win ON r.s = win.s AND r.n = win.n),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}

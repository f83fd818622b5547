"""From raw documents to token ids: each stage works on all that the one before it kept, and its decisions take effect.

Rows with null or empty texts, or null ids, are clean: they pass all stages, and have no ids. Rows that repeat stay or go
together; of columns, those of documents go on. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calipra.llm.bpe import bpe_round_trip
from calipra.llm.common import delete, new_path, released
from calipra.llm.decontam import drop_contaminated
from calipra.llm.line_dedup import line_dedup
from calipra.llm.near_dup import drop_near_dups
from calipra.llm.queries import TOKENIZER
from calipra.llm.toxicity import drop_toxic, fit

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores at 0.3 or more go. It is fitted on labelled rows of the documents given, held-out ones left out."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a share of a source's documents go; n_chars follows. No document does."""
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return drop_near_dups(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document that is left: number and digest of its ids, and digest of the text decoded from them."""
    return bpe_round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near-dedup", near_dups), ("decontamination", decontamination), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written in the shared folder and read again for the next.

    Once it is written, the tables that the stage made on its way, and the result of the one before, are deleted.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the scores nor the ids; the stages are tested against plain versions in tests/llm.
ORACLE_SQL = None

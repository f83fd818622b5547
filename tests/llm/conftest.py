from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 997} and{i % 89}" for i in range(30_000)) + "\n" + "x" * 50_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, id long, key string, host string, `rank` int, block int, n_lines string, score string, label string"


def document(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), 7, 8, "k", "h", 9, 1, "nl", "sc", "lb")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and other columns whose names operators use as well."""
    rows = [
        document(1, "The quick brown fox jumps over the lazy dog\nshared line of text"),
        document(1, "The quick brown fox jumps over the lazy dog\nshared line of text"),
        document(2, None), document(3, ""), document(4, " \n\t "), document(5, LONG), document(6, "naïve café — 日本語 <|endoftext|> '‘\r\n", None),
        document(None, "no id here at all, but some words to read"), document(7, "The quick brown fox jumps over the lazy dog\nshared line of text"),
        (8, None, None, None, None, None, None, None, None, None, None, None, None, None), document(9, "one two"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

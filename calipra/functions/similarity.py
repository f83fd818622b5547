"""Similarity of texts by matching blocks (Ratcliff and Obershelp), which no built-in function computes."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all characters; not symmetric in general, so the order of arguments counts."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR-26 in Arrow batches; null counts as empty, and two empty texts are alike."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

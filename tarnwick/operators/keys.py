"""Joins on keys that may be null, as in a group by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_back(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of ``other``, a row of which stands for each group of the keys; null equals null. Adaptive execution splits a key that most rows have."""
    named = {k: f"_of_{i}" for i, k in enumerate(keys)}
    right = other.select(*(F.col(k).alias(n) for k, n in named.items()), *(c for c in other.columns if c not in named))
    return df.join(right, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in named.items())), how).drop(*named.values())

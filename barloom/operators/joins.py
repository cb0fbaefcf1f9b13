"""Broadcasts of counted tables, and joins in which null keys meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 1_000_000


def counted(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast in a join if it has been counted to have at most so many rows, else merged after a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_merge")


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Both merged after a shuffle by keys, which are the left ones; null keys meet each other."""
    named = right.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys)).hint("shuffle_merge")
    return left.join(named, [left[k].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)], how).drop(*(f"_key{i}" for i in range(len(keys) if how != "left_semi" else 0)))

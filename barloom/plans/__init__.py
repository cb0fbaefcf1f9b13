"""Registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.plans import bar_queries, feature_queries, metric_queries, stream_queries, trade_queries  # noqa: F401
from barloom.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols with their session type and quality flags."""
    return QUERIES["A5_symbol_flags"](spark, folder)


__all__ = ["ORACLES", "QUERIES", "flagship"]

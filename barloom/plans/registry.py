"""The queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is what follows the common table expressions."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = function
        if sql is not None:
            inner = f"SELECT * FROM ({sql})" if sql.startswith("WITH ") and ctes else sql
            ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + inner
        return function

    return register

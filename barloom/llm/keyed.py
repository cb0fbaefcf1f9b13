"""A join with totals of keys of which a few may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000
"""A key is heavy if it holds more than one row in SHARE; there can be fewer than SHARE of those, so they are broadcast."""


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Each row with the totals of its key; null keys meet each other, rows without a total are left out.

    totals has one row for each key, and in weight how many of the rows hold it (at least). Heavy keys are
    met where the rows are, all others by a shuffle in which no key holds more than one row in SHARE. Both tables
    are read twice, so give tables that are written out.
    """
    whole = totals.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in totals.columns if c not in (*keys, weight)]
    side = totals.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *values, (F.col(weight) * SHARE > whole).alias("_heavy"))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return reduce(Column.__and__, (left[k].eqNullSafe(right[f"_key{i}"]) for i, k in enumerate(keys)))

    heavy, light = side.where("_heavy"), side.where("NOT _heavy")
    met = rows.join(F.broadcast(heavy), same(rows, heavy), "left")
    rest = met.where("_heavy IS NULL").select(*rows.columns)
    rest = rest.join(light.hint("shuffle_merge"), same(rest, light))
    return met.where("_heavy").select(*rows.columns, *values).unionByName(rest.select(*rows.columns, *values))

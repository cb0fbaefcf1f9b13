"""Quantiles by three rules that must not be mixed: nearest rank, floor rank and linear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import meet
from barloom.scratch import scratch_folder


def _in_group(df: DataFrame, keys: Sequence[str], column: str, picks: dict[str, Column]) -> DataFrame:
    """picks of groups that a parameter bounds: each is sorted in one task."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).withColumns({"_r": F.row_number().over(whole.orderBy(x)), "_n": F.count(F.lit(1)).over(whole)})
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == r, x)).alias(name) for name, r in picks.items()])


def _by_rank(df: DataFrame, keys: Sequence[str], picks: dict[str, dict[str, Column]]) -> DataFrame:
    """For each column its outputs with their 1-based ranks over `_n` values that are neither null nor NaN; and n_<column>.

    A selection over ranges: equal values are counted first, the distinct ones dealt out by ranges of (keys, column, value),
    and the ranges' counts tell which one holds a rank; only that one is sorted. So a group spreads over as many tasks as it
    needs, ties weigh nothing, and a window holds a group's ranges or one range of its values. All columns go in one pass.
    """
    own, n_of = [*keys, "_column"], {c: f"n_{c}" for c in picks}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in picks)))
    rows = df.select(*keys, each.alias("_e")).select(*keys, "_e._column", "_e._x")
    counts = rows.where("_x IS NOT NULL AND NOT isnan(_x)").groupBy(*own, "_x").agg(F.count(F.lit(1)).alias("_c"))
    place = scratch_folder(df.sparkSession, "ranks")
    counts.repartitionByRange(*own, "_x").withColumn("_part", F.spark_partition_id()).write.parquet(place)
    values = df.sparkSession.read.parquet(place)
    parts = values.groupBy(*own, "_part").agg(F.sum("_c").alias("_in"))
    whole = Window.partitionBy(*own)
    before = F.coalesce(F.sum("_in").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_n": F.sum("_in").over(whole), "_before": before})
    asked = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(name).alias("name"), r.cast("long").alias("r")) for c, ranks in picks.items() for name, r in ranks.items())))
    asked = parts.withColumn("_pick", asked).where("_pick.c = _column AND _pick.r > _before AND _pick.r <= _before + _in")
    asked = asked.select(*own, "_part", "_n", F.col("_pick.name").alias("_name"), (F.col("_pick.r") - F.col("_before")).alias("_r"))
    upto = F.sum("_c").over(Window.partitionBy(*own, "_part", "_name").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    found = meet(values, asked, [*own, "_part"]).withColumn("_upto", upto).where("_upto >= _r AND _upto - _c < _r")
    chosen = [F.max(F.when((F.col("_column") == c) & (F.col("_name") == name), F.col("_x"))).alias(name) for c, ranks in picks.items() for name in ranks]
    return found.groupBy(*keys).agg(*chosen, *(F.max(F.when(F.col("_column") == c, F.col("_n"))).alias(n) for c, n in n_of.items()))


def _nearest(q: float) -> Column:
    return F.round((F.col("_n") - 1) * F.lit(q)) + 1


def _floor(q: float) -> Column:
    return F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1) + 1


def nearest_ranks(df: DataFrame, keys: Sequence[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Exact nearest-rank quantiles of several columns {column: {name: q}}: the value of rank round((n - 1) q) + 1."""
    out = _by_rank(df, keys, {c: {name: _nearest(q) for name, q in own.items()} for c, own in wanted.items()})
    return out.drop(*(f"n_{c}" for c in wanted))


def nearest_rank(df: DataFrame, keys: Sequence[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    return nearest_ranks(df, keys, {column: quantiles})


def floor_ranks(df: DataFrame, keys: Sequence[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Exact floor-rank quantiles of several columns: the value of rank min(floor(n q), n - 1) + 1."""
    out = _by_rank(df, keys, {c: {name: _floor(q) for name, q in own.items()} for c, own in wanted.items()})
    return out.drop(*(f"n_{c}" for c in wanted))


def floor_rank(df: DataFrame, keys: Sequence[str], column: str, quantiles: dict[str, float], bounded: bool = False) -> DataFrame:
    """bounded: a parameter bounds the groups."""
    if bounded:
        return _in_group(df, keys, column, {name: _floor(q) for name, q in quantiles.items()})
    return floor_ranks(df, keys, {column: quantiles})


def linear_ranks(df: DataFrame, keys: Sequence[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Exact quantiles of several columns with linear interpolation between the two nearest ranks."""
    at = {name: (c, q) for c, own in wanted.items() for name, q in own.items()}
    ends = {c: {f"_{side}_{name}": f((F.col("_n") - 1) * F.lit(q)) + 1 for name, q in own.items() for side, f in (("low", F.floor), ("high", F.ceil))} for c, own in wanted.items()}
    out = _by_rank(df, keys, ends)

    def value(name: str) -> Column:
        column, q = at[name]
        place = (F.col(f"n_{column}") - 1) * F.lit(q)
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return out.select(*keys, *(value(name).alias(name) for name in at))


def linear(column: str | Column, q: float) -> Column:
    """Exact quantile with linear interpolation, as an aggregate."""
    return F.percentile(column, F.lit(q))


def full(count: int, value: Column, x: Column, frame) -> Column:
    """A rolling aggregate that is null until the frame has so many values."""
    return F.when(F.count(x).over(frame) == count, value)

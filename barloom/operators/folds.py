"""Walk-forward folds and what falls into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import counted


def _table(bounds: DataFrame, step: Column, at) -> DataFrame:
    """Folds k = 0, 1, ... of each symbol whose end is not after its last time. at(k): the four bounds."""
    rows = bounds.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(step, F.lit(0)).cast("int"))))
    a, b, c, d = at(F.col("k"))
    rows = rows.select("symbol", F.format_string("F%02d", "k").alias("fold_id"), a.alias("is_start"), b.alias("is_end"), c.alias("oos_start"), d.alias("oos_end"), "last")
    return rows.where("oos_end <= last").drop("last")


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def rolling_folds(bounds: DataFrame, is_days: int, embargo_days: int, oos_days: int, step_days: int, expanding: bool = False) -> DataFrame:
    """Folds of whole days. bounds: symbol, first, last. expanding: every fold is in-sample from the first time on."""
    first = F.col("first")

    def at(k: Column) -> tuple[Column, ...]:
        start = k * step_days
        return (first if expanding else first + _days(start), first + _days(start + is_days), first + _days(start + is_days + embargo_days), first + _days(start + is_days + embargo_days + oos_days))

    return _table(bounds, F.datediff("last", "first") / step_days, at)


def fixed_month_folds(bounds: DataFrame, is_months: int, oos_months: int, step_months: int, embargo_days: int, month_days: float = 30.44) -> DataFrame:
    """Folds whose months all have the same length (30.44 or 30 days), to the second."""
    first, second = F.col("first"), lambda days: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(days * 86400).cast("decimal(18,6)"))

    def at(k: Column) -> tuple[Column, ...]:
        start = k * (step_months * month_days)
        end = start + is_months * month_days
        return first + second(start), first + second(end), first + second(end + embargo_days), first + second(end + embargo_days + oos_months * month_days)

    return _table(bounds, F.datediff("last", "first") / (step_months * month_days), at)


def calendar_month_folds(bounds: DataFrame, is_months: int, oos_months: int, step_months: int, embargo_seconds: int) -> DataFrame:
    """Folds of calendar months from the first day of the first month; the embargo follows the in-sample end."""
    first = F.date_trunc("month", F.col("first"))

    def at(k: Column) -> tuple[Column, ...]:
        start, end = F.add_months(first, k * step_months), F.add_months(first, k * step_months + is_months)
        gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(embargo_seconds).cast("decimal(18,6)"))
        out = end.cast("timestamp") + gap
        return start.cast("timestamp"), end.cast("timestamp"), out, F.add_months(first, k * step_months + is_months + oos_months).cast("timestamp") + gap

    return _table(bounds, F.months_between("last", "first") / step_months, at)


def first_sufficient(options: list[DataFrame], least: int = 6) -> DataFrame:
    """For each symbol the folds of the first option that has so many of them; else of the option with most."""
    union = None
    for k, option in enumerate(options):
        one = option.withColumn("option", F.lit(k))
        union = one if union is None else union.unionByName(one)
    size = union.groupBy("symbol", "option").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("symbol").orderBy((F.col("n") >= least).desc(), F.when(F.col("n") >= least, 0).otherwise(-F.col("n")), "option")
    best = size.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("symbol", "option")
    return union.join(counted(best), ["symbol", "option"])


def non_overlapping(folds: DataFrame) -> DataFrame:
    """ok: the fold's out-of-sample part begins at or after the end of the one before."""
    before = F.lag("oos_end").over(Window.partitionBy("symbol").orderBy("oos_start"))
    return folds.withColumn("ok", F.coalesce(F.col("oos_start") >= before, F.lit(True)))


def _by_day(parts: DataFrame, start: str, end: str) -> DataFrame:
    """Once for each day from start to end, so that a part meets only the rows of its own days."""
    return parts.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end)))).hint("shuffle_merge")


def tag_segments(rows: DataFrame, folds: DataFrame, time: str) -> DataFrame:
    """Rows once for each fold part that they fall into (bounds included), as fold_id and segment."""
    parts = folds.select("symbol", "fold_id", F.explode(F.array(F.struct(F.lit("IS").alias("segment"), F.col("is_start").alias("a"), F.col("is_end").alias("b")), F.struct(F.lit("OOS").alias("segment"), F.col("oos_start").alias("a"), F.col("oos_end").alias("b")))).alias("p"))
    parts = parts.select("symbol", "fold_id", "p.segment", "p.a", "p.b").where("a <= b")
    tagged = rows.withColumn("_day", F.to_date(time)).join(_by_day(parts, "a", "b"), ["symbol", "_day"])
    return tagged.where((F.col(time) >= F.col("a")) & (F.col(time) <= F.col("b"))).drop("a", "b", "_day")


def range_counts(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars between is_start and is_end of each fold of a symbol with bars, the end excluded and included."""
    rows = bars.select("symbol", "time_utc", F.to_date("time_utc").alias("_day")).join(_by_day(folds.select("symbol", "fold_id", "is_start", "is_end").where("is_start <= is_end"), "is_start", "is_end"), ["symbol", "_day"])
    t = F.col("time_utc")
    found = rows.groupBy("symbol", "fold_id").agg(F.count_if((t >= F.col("is_start")) & (t < F.col("is_end"))).alias("half_open"), F.count_if((t >= F.col("is_start")) & (t <= F.col("is_end"))).alias("closed"))
    own = folds.select("symbol", "fold_id").distinct().join(bars.select("symbol").distinct().hint("shuffle_merge"), "symbol", "left_semi")
    return own.join(found.hint("shuffle_merge"), ["symbol", "fold_id"], "left").fillna(0, ["half_open", "closed"])


def fold_counts(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars and days in both parts of each fold, ends excluded."""
    spans = folds.withColumns({"a": F.least("is_start", "oos_start"), "b": F.greatest("is_end", "oos_end")})
    rows = bars.select("symbol", "time_utc", F.to_date("time_utc").alias("_day")).join(_by_day(spans, "a", "b"), ["symbol", "_day"])
    inside = lambda a, b: (F.col("time_utc") >= F.col(a)) & (F.col("time_utc") < F.col(b))
    found = rows.groupBy("symbol", "fold_id").agg(
        F.count_if(inside("is_start", "is_end")).alias("is_bars"), F.count_if(inside("oos_start", "oos_end")).alias("oos_bars"),
        F.countDistinct(F.when(inside("is_start", "is_end"), F.col("_day"))).alias("is_days"), F.countDistinct(F.when(inside("oos_start", "oos_end"), F.col("_day"))).alias("oos_days"),
    )
    # Folds of a symbol that has bars, but none in the fold, count 0.
    known = folds.select("symbol", "fold_id").join(bars.select("symbol").distinct().hint("shuffle_merge"), "symbol", "left_semi")
    return known.join(found.hint("shuffle_merge"), ["symbol", "fold_id"], "left").fillna(0, ["is_bars", "oos_bars", "is_days", "oos_days"])

"""Rolling features of bars, all over one window by symbol and time."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import full
from barloom.operators.joins import counted

EPSILON = 1e-12


def by_time():
    return Window.partitionBy("symbol").orderBy("time_utc")



def roll(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def returns(bars: DataFrame) -> DataFrame:
    """ret and abs_diff against the bar before; null where that close is not positive."""
    prev = F.lag("close").over(by_time())
    return bars.withColumn("prev_close", prev).withColumns({"ret": F.when(F.col("prev_close") > 0, F.col("close") / F.col("prev_close") - 1), "abs_diff": F.abs(F.col("close") - F.col("prev_close"))})


def volatility(bars: DataFrame, n: int) -> DataFrame:
    """vol_bps: sample deviation of returns over n bars."""
    return bars.withColumn("vol_bps", full(n, F.stddev_samp("ret").over(roll(n)), F.col("ret"), roll(n)) * 10000)


def momentum(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("mom_bps", (F.try_divide("close", F.lag("close", n).over(by_time())) - 1) * 10000)


def efficiency_ratio(bars: DataFrame, n: int, epsilon: float = EPSILON) -> DataFrame:
    path = full(n, F.sum("abs_diff").over(roll(n)), F.col("abs_diff"), roll(n))
    return bars.withColumn("er", F.try_divide(F.abs(F.col("close") - F.lag("close", n).over(by_time())), path + epsilon))


def average_true_range(bars: DataFrame, n: int) -> DataFrame:
    """tr, atr (price) and atr_bps."""
    high, low, prev = F.col("high"), F.col("low"), F.col("prev_close")
    rows = bars.withColumn("tr", F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)))
    rows = rows.withColumn("atr", full(n, F.avg("tr").over(roll(n)), F.col("tr"), roll(n)))
    return rows.withColumn("atr_bps", F.try_divide("atr", "close") * 10000)


def momentum_efficiency(bars: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    return bars.withColumn("mom_eff", F.abs("mom_bps") / (F.col("vol_bps") + epsilon))


def ewm(bars: DataFrame, column: str, span: int, name: str, adjust: bool = False) -> DataFrame:
    """Exponential moving average of a symbol's bars, in two passes over chunks of one day.

    A chunk's bars turn a carry a into a * decay + offset. Chunks are chained over one row each, and
    the carry is then applied inside the chunk, so no task holds a whole series. A day has several
    chunks where keep ** -k would leave the range of a double. adjust: the weighted form, a ratio of two such averages.
    """
    keep = 1 - 2 / (span + 1)
    if keep <= 0:
        return bars.withColumn(name, F.col(column).cast("double"))
    longest = max(1, int(500 / -math.log(keep)))
    rows = bars.withColumn("_d", F.to_date("time_utc")).withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "_d").orderBy("time_utc")))
    rows = rows.withColumn("_day", F.struct("_d", F.expr(f"(_k - 1) div {longest}").alias("part"))).withColumn("_k", (F.col("_k") - 1) % longest + 1).drop("_d")
    starts = counted(bars.groupBy("symbol").agg(F.min("time_utc").alias("_first")))
    rows = rows.join(starts, "symbol")
    first = F.col("time_utc") == F.col("_first")
    gain = F.lit(1 - keep) if not adjust else F.lit(1.0)
    rows = rows.withColumn("_start", first)
    rows = rows.withColumn("_x", F.when(F.col("_start") & F.lit(not adjust), F.col(column)).otherwise(gain * F.col(column)))
    rows = rows.withColumn("_w", F.lit(1.0))
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol", "_day"))
    # Inside a chunk, in terms of keep**-k, which stays below e**500.
    inside = Window.partitionBy("symbol", "_day").orderBy("time_utc").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": size, "_cx": F.sum(F.col("_x") * F.pow(F.lit(keep), -F.col("_k"))).over(inside), "_cw": F.sum(F.col("_w") * F.pow(F.lit(keep), -F.col("_k"))).over(inside)})
    scale = F.pow(F.lit(keep), F.col("_k"))
    rows = rows.withColumns({"_px": F.col("_cx") * scale, "_pw": F.col("_cw") * scale})
    days = rows.where("_k = _n").select("symbol", F.col("_day._d").alias("d"), F.col("_day.part").alias("part"), F.col("_n").alias("n"), F.col("_px").alias("px"), F.col("_pw").alias("pw"))

    def chain(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values(["d", "part"])
        ax = aw = 0.0
        before = []
        for n, px, pw in zip(days["n"], days["px"], days["pw"], strict=True):
            before.append((ax, aw))
            ax, aw = ax * keep**n + px, aw * keep**n + pw
        return pd.DataFrame({"symbol": days["symbol"], "d": days["d"], "part": days["part"], "_ax": [a for a, _ in before], "_aw": [b for _, b in before]})

    carry = days.groupBy("symbol").applyInPandas(chain, "symbol string, d date, part long, _ax double, _aw double")
    carry = carry.select("symbol", F.struct(F.col("d").alias("_d"), "part").alias("_day"), "_ax", "_aw")
    rows = rows.join(carry.hint("shuffle_merge"), ["symbol", "_day"])
    x, w = F.col("_px") + scale * F.col("_ax"), F.col("_pw") + scale * F.col("_aw")
    return rows.withColumn(name, x / w if adjust else x).drop("_day", "_k", "_first", "_start", "_x", "_w", "_n", "_cx", "_cw", "_px", "_pw", "_ax", "_aw")


def trend(bars: DataFrame, fast: str, slow: str, slope: int = 50) -> DataFrame:
    """Direction, strength and slope of two averages, and whether they crossed."""
    diff = F.col(fast) - F.col(slow)
    rows = bars.withColumns({"trend_dir": F.signum(diff), "trend_bps": F.try_divide(diff, F.col(slow)) * 10000, "slope_bps": (F.try_divide(F.col(slow), F.lag(slow, slope).over(by_time())) - 1) * 10000})
    return rows.withColumn("cross", (F.col("trend_dir") != F.lag("trend_dir").over(by_time())) & (F.col("trend_dir") != 0))


def bollinger(bars: DataFrame, n: int, k: float = 2.0, floor: float | None = None) -> DataFrame:
    """Middle, deviation, bands and %B; floor: the least band width, else epsilon is added to it."""
    rows = bars.withColumns({"bb_mid": full(n, F.avg("close").over(roll(n)), F.col("close"), roll(n)), "bb_std": full(n, F.stddev_samp("close").over(roll(n)), F.col("close"), roll(n))})
    rows = rows.withColumns({"bb_up": F.col("bb_mid") + k * F.col("bb_std"), "bb_low": F.col("bb_mid") - k * F.col("bb_std")})
    width = F.col("bb_up") - F.col("bb_low")
    width = width + EPSILON if floor is None else F.when(width.isNotNull(), F.greatest(width, F.lit(floor)))
    return rows.withColumn("pct_b", (F.col("close") - F.col("bb_low")) / width)


def range_features(bars: DataFrame, n: int) -> DataFrame:
    """dist_mean_atr and range_width_atr."""
    atr = F.when(F.col("atr").isNotNull(), F.greatest("atr", F.lit(1e-10)))
    span = full(n, F.max("high").over(roll(n)) - F.min("low").over(roll(n)), F.col("high"), roll(n))
    return bars.withColumns({"dist_mean_atr": (F.col("close") - F.col("bb_mid")) / atr, "range_width_atr": span / atr})


def change(bars: DataFrame, column: str, n: int, name: str) -> DataFrame:
    return bars.withColumn(name, F.col(column) - F.lag(column, n).over(by_time()))


def forward_returns(bars: DataFrame, horizons: Sequence[int], side: Column | None = None) -> DataFrame:
    """fwd_h: return to the close h bars on, signed by side."""
    sign = F.lit(1) if side is None else F.when(side == "SHORT", -1).otherwise(1)
    return bars.withColumns({f"fwd_{h}": sign * (F.try_divide(F.lead("close", h).over(by_time()), "close") - 1) for h in horizons})


def warm(bars: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Without each symbol's first n bars and rows that lack a feature."""
    return bars.withColumn("_rn", F.row_number().over(by_time())).where(F.col("_rn") > n).drop("_rn").dropna(subset=list(columns))


def streak(bars: DataFrame, gate: str, k: int, name: str) -> DataFrame:
    """True where the gate holds at this bar and the k - 1 before it."""
    on = F.coalesce(F.col(gate), F.lit(False)).cast("int")
    return bars.withColumn(name, F.coalesce(F.sum(on).over(roll(k)) == k, F.lit(False)))


def off_streak(bars: DataFrame, gate: str, name: str) -> DataFrame:
    """How many bars in a row the gate has been off."""
    rows = bars.withColumn("_island", F.sum(F.coalesce(F.col(gate), F.lit(False)).cast("int")).over(by_time()))
    off = F.sum((~F.coalesce(F.col(gate), F.lit(False))).cast("int")).over(Window.partitionBy("symbol", "_island").orderBy("time_utc").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(F.coalesce(F.col(gate), F.lit(False)), 0).otherwise(off)).drop("_island")


def all_features(bars: DataFrame, long: int, short: int) -> DataFrame:
    """Trend and range features; long and short are numbers of bars."""
    rows = momentum_efficiency(average_true_range(efficiency_ratio(momentum(volatility(returns(bars), long), long), long), short))
    return change(range_features(bollinger(rows, short), short), "dist_mean_atr", 3, "dist_vel_3")

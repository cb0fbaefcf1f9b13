"""Regime gates: thresholds from quantiles, and the bars that pass them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import floor_ranks, linear_ranks, nearest_ranks
from barloom.operators.joins import counted
from barloom.operators.folds import tag_segments

# Quantile schemes in the order in which they are tried.
SCHEMES = (("BASE", 0.60, 0.55, 0.90), ("RELAX1", 0.50, 0.50, 0.95), ("RELAX2", 0.40, 0.50, 0.99), ("TIGHT1", 0.70, 0.60, 0.85))


def trend_gate(bars: DataFrame, q_er: float = 0.60, q_mom: float = 0.55, q_vol: float = 0.90) -> DataFrame:
    """gate_long and gate_short from each symbol's own quantiles of er, mom_bps and vol_bps."""
    a = floor_ranks(bars, ["symbol"], {"er": {"thr_er": q_er}, "mom_bps": {"thr_mom": q_mom, "thr_mom_short": 1 - q_mom}, "vol_bps": {"thr_vol": q_vol}})
    base = (F.col("er") >= F.col("thr_er")) & (F.col("vol_bps") <= F.col("thr_vol"))
    rows = bars.join(counted(a), "symbol", "left")
    off = F.lit(False)
    return rows.withColumns({"gate_long": F.coalesce(base & (F.col("mom_bps") >= F.col("thr_mom")), off), "gate_short": F.coalesce(base & (F.col("mom_bps") <= F.col("thr_mom_short")), off)})


def range_gate(bars: DataFrame, q_er: float = 0.40, q_vol: float = 0.90) -> DataFrame:
    a = floor_ranks(bars, ["symbol"], {"er": {"thr_er": q_er}, "vol_bps": {"thr_vol": q_vol}})
    rows = bars.join(counted(a), "symbol", "left")
    return rows.withColumn("gate", F.coalesce((F.col("er") <= F.col("thr_er")) & (F.col("vol_bps") <= F.col("thr_vol")), F.lit(False)))


def _passes(side: Column, er: Column, mom: Column, vol: Column) -> Column:
    momentum = F.when(side == "LONG", F.col("mom_bps") >= mom).otherwise(F.col("mom_bps") <= mom)
    return (F.col("er") >= er) & momentum & (F.col("vol_bps") <= vol)


def calibrate_trend(bars: DataFrame, folds: DataFrame, min_rows: int = 5000, least: float = 0.05, most: float = 0.80, goal: float = 0.30) -> DataFrame:
    """Thresholds by symbol, fold and side: the first scheme whose in-sample coverage is in range, else the one nearest the goal; SKIP with few rows."""
    rows = tag_segments(bars.dropna(subset=["er", "mom_bps", "vol_bps"]), folds, "time_utc")
    inside = rows.where("segment = 'IS'")
    keys = ["symbol", "fold_id"]
    named = lambda name, k: {f"{name}_{s[0]}": s[k] for s in SCHEMES}
    wide = nearest_ranks(inside, keys, {"er": named("er", 1), "mom_bps": named("long", 2) | {f"short_{s[0]}": 1 - s[2] for s in SCHEMES}, "vol_bps": named("vol", 3)})
    options = F.array(*[
        F.struct(F.lit(k).alias("rank"), F.lit(s[0]).alias("scheme"), F.lit(side).alias("side"), F.col(f"er_{s[0]}").alias("thr_er"),
                 (F.greatest(F.lit(0.0), F.col(f"long_{s[0]}")) if side == "LONG" else F.least(F.lit(0.0), F.col(f"short_{s[0]}"))).alias("thr_mom"), F.col(f"vol_{s[0]}").alias("thr_vol"))
        for k, s in enumerate(SCHEMES) for side in ("LONG", "SHORT")
    ])
    schemes = wide.select(*keys, F.explode(options).alias("o")).select(*keys, "o.*")
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("segment") == "IS").alias("n_is"), F.count_if(F.col("segment") == "OOS").alias("n_oos"))
    tested = rows.select(*keys, "segment", "er", "mom_bps", "vol_bps").join(schemes.hint("shuffle_merge"), keys)
    passed = _passes(F.col("side"), F.col("thr_er"), F.col("thr_mom"), F.col("thr_vol")).cast("double")
    cover = tested.groupBy(*keys, "side", "rank", "scheme", "thr_er", "thr_mom", "thr_vol").agg(F.avg(F.when(F.col("segment") == "IS", passed)).alias("cov_is"), F.coalesce(F.avg(F.when(F.col("segment") == "OOS", passed)), F.lit(0.0)).alias("cov_oos"))
    good = F.col("cov_is").between(least, most)
    order = Window.partitionBy(*keys, "side").orderBy(good.desc(), F.when(good, 0.0).otherwise(F.round(F.abs(F.col("cov_is") - goal), 9)), "rank")
    best = cover.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "rank").join(sizes.hint("shuffle_merge"), keys)
    few = F.col("n_is") < min_rows
    null = lambda c: F.when(~few, F.col(c)).alias(c)
    return best.select(*keys, "side", F.when(few, "SKIP").otherwise(F.col("scheme")).alias("scheme"), null("thr_er"), null("thr_mom"), null("thr_vol"), F.when(few, 0.0).otherwise(F.col("cov_is")).alias("cov_is"), F.when(few, 0.0).otherwise(F.col("cov_oos")).alias("cov_oos"), "n_is", "n_oos")


def calibrate_range(bars: DataFrame, folds: DataFrame, q_er: float = 0.15, q_vol: float = 0.60, q_width: float = 0.80) -> DataFrame:
    """Thresholds of the range gate by symbol and fold, with coverage in both parts."""
    rows = tag_segments(bars.dropna(subset=["er", "vol_bps", "range_width_atr"]), folds, "time_utc")
    inside, keys = rows.where("segment = 'IS'"), ["symbol", "fold_id"]
    found = nearest_ranks(inside, keys, {"er": {"thr_er": q_er}, "vol_bps": {"thr_vol": q_vol}, "range_width_atr": {"thr_width": q_width}})
    passed = ((F.col("er") <= F.col("thr_er")) & (F.col("vol_bps") <= F.col("thr_vol")) & (F.col("range_width_atr") <= F.col("thr_width"))).cast("double")
    return rows.join(found.hint("shuffle_merge"), keys).groupBy(*keys, "thr_er", "thr_vol", "thr_width").agg(F.avg(F.when(F.col("segment") == "IS", passed)).alias("cov_is"), F.coalesce(F.avg(F.when(F.col("segment") == "OOS", passed)), F.lit(0.0)).alias("cov_oos"))


def apply_thresholds(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows (symbol, fold_id, features) with the gate of each side; parameters without thresholds are skipped."""
    known = params.where("thr_er is not null").select("symbol", "fold_id", "side", "thr_er", "thr_mom", "thr_vol")
    return rows.join(known.hint("shuffle_merge"), ["symbol", "fold_id"]).withColumn("gate", F.coalesce(_passes(F.col("side"), F.col("thr_er"), F.col("thr_mom"), F.col("thr_vol")), F.lit(False)))


def mean_reversion(bars: DataFrame, k: float, velocity: float = 0.1) -> DataFrame:
    """signal_long and signal_short: far from the mean and turning back."""
    d, v = F.col("dist_mean_atr"), F.col("dist_vel_3")
    return bars.withColumns({"signal_long": F.coalesce((d <= -k) & (v > velocity), F.lit(False)), "signal_short": F.coalesce((d >= k) & (v < -velocity), F.lit(False))})


def terciles(rows: DataFrame, column: str, name: str) -> DataFrame:
    """low, mid or high by the linear terciles of the whole table."""
    cuts = linear_ranks(rows, [], {column: {"_a": 0.333, "_b": 0.667}})
    x = F.col(column)
    return rows.join(F.broadcast(cuts)).withColumn(name, F.when(x.isNull(), F.lit(None)).when(x <= F.col("_a"), "low").when(x <= F.col("_b"), "mid").otherwise("high")).drop("_a", "_b")

"""Statistical tests on daily returns and on tables of candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import meet


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_tail(t: float, df: float) -> float:
    """P(T > t) by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0 if t > 0 else 1.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 0.5
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = (b, a, 1 - x) if flip else (a, b, x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * math.log(y) + q * math.log1p(-y)) / p
    tiny, c, d = 1e-300, 1.0, 1 - (p + q) * y / (p + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / (1 + k * d if abs(1 + k * d) > tiny else tiny)
            c = 1 + k / c if abs(1 + k / c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    half = (1 - front * h if flip else front * h) / 2
    return half if t > 0 else 1 - half


def _p_values(rows: DataFrame, t: str, df: str | None, name: str) -> DataFrame:
    """One-sided p-values of a small result table."""

    def work(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else normal_tail(x) if pd.isna(k) else t_tail(x, k) for x, k in zip(t, df, strict=True)], dtype="float64")

    udf = F.pandas_udf(work, "double")
    return rows.withColumn(name, udf(F.col(t), F.col(df).cast("double") if df else F.lit(None).cast("double")))


LAG_BLOCK = 1024
"""Positions of a series in a block, or as many as there are lags if these are more."""


def hac_t(daily: DataFrame, keys: Sequence[str], column: str = "ret", order: str = "day", lags: int | None = None) -> DataFrame:
    """Newey-West t-statistic of the mean with Bartlett weights and L = max(1, floor(4 (T / 100)^(2/9))) lags, or as many as given.

    A series is cut into blocks of positions, each with the block before it as its halo, so lags reach across; a block adds up the
    weighted products of its values with those up to L places before them, and the blocks' sums are added. Any number of lags works.
    """
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    rows = daily.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"), (F.row_number().over(w) - 1).alias("_pos"), F.count(F.lit(1)).over(whole).alias("n_obs"), F.avg(column).over(whole).alias("mean"))
    most = F.lit(lags).cast("long") if lags else F.greatest(F.lit(1).cast("long"), F.floor(4 * F.pow(F.col("n_obs") / 100.0, F.lit(2 / 9))))
    rows = rows.withColumns({"max_lags": most, "_u": F.col("_x") - F.col("mean")})
    widest = lags or daily.groupBy(*keys).count().agg(F.max(F.floor(4 * F.pow(F.col("count") / 100.0, F.lit(2 / 9))))).first()[0] or 1
    size = max(LAG_BLOCK, int(widest))
    own = [*keys, "_block"]
    held = rows.groupBy(*keys, F.expr(f"cast(_pos as long) div {size}").alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_u"))).getField("_u").alias("_values"), F.max("n_obs").alias("n_obs"), F.max("mean").alias("mean"), F.max("max_lags").alias("max_lags"),
    )
    before = held.select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_values").alias("_before"))
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values, halo, most in zip(batch.column("_values").to_pylist(), batch.column("_before").to_pylist(), batch.column("max_lags").to_pylist(), strict=True):
                u = np.array(values)
                line = np.r_[np.array(halo or [], float)[-most:], u]
                start = len(line) - len(u)
                total = u @ u
                for k in range(1, min(most, len(line) - 1) + 1):
                    first = max(start, k)
                    total += 2 * (1 - k / (most + 1)) * (line[first:] @ line[first - k : len(line) - k])
                out.append(float(total))
            kept = [batch.column(c) for c in (*keys, "n_obs", "mean", "max_lags")]
            yield pa.record_batch([*kept, pa.array(out, pa.float64())], [*keys, "n_obs", "mean", "max_lags", "_v"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_obs long, mean double, max_lags long, _v double"])
    parts = meet(held, before, own, "left").select(*keys, "n_obs", "mean", "max_lags", "_values", "_before").mapInArrow(work, schema)
    out = parts.groupBy(*keys, "n_obs", "mean", "max_lags").agg(F.sum("_v").alias("_v"))
    se = F.sqrt(F.greatest("_v", F.lit(0.0))) / F.col("n_obs")
    return out.withColumn("t_stat", F.when(F.col("n_obs") >= 5, F.try_divide("mean", se))).select(*keys, "n_obs", "max_lags", "t_stat")


def hac_test(daily: DataFrame, keys: Sequence[str], column: str = "ret") -> DataFrame:
    """hac_t with a one-sided p-value and verdict."""
    out = _p_values(hac_t(daily, keys, column), "t_stat", None, "p_value")
    verdict = F.when(F.col("t_stat").isNull(), "INSUFFICIENT_DATA").when(F.col("p_value") < 0.05, "PASS").when(F.col("p_value") < 0.10, "WARN").otherwise("FAIL")
    return out.withColumn("verdict", F.when((F.col("n_obs") < 30) & F.col("t_stat").isNotNull(), F.concat(verdict, F.lit(" (LOW_POWER)"))).otherwise(verdict))


def slope(rows: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares slope of y on x with its t-statistic."""
    out = rows.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_sxx(F.col(y), F.col(x)).alias("sxx"), F.regr_syy(F.col(y), F.col(x)).alias("syy"), F.regr_sxy(F.col(y), F.col(x)).alias("sxy"), F.regr_count(F.col(y), F.col(x)).alias("n"))
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    se = F.sqrt(F.try_divide(sse / F.greatest(F.col("n") - 2, F.lit(1)), F.greatest("sxx", F.lit(1e-12))))
    return out.withColumn("t_stat", F.coalesce(F.try_divide("slope", se), F.lit(0.0))).select(*keys, "n", "slope", "t_stat")


def overfit_share(tuning: DataFrame, oos: DataFrame) -> DataFrame:
    """One row: share of folds whose best in-sample score beats the median while the fold loses out of sample."""
    folds = tuning.groupBy("fold_id").agg(F.max("score").alias("best"), F.median("score").alias("mid"))
    rows = folds.join(oos.groupBy("fold_id").agg(F.sum("net_pnl_base").alias("total")).hint("shuffle_merge"), "fold_id").withColumn("over", (F.col("best") > F.col("mid")) & (F.col("total") < 0))
    return _overfit(rows)


def _overfit(rows: DataFrame) -> DataFrame:
    out = rows.agg(F.count(F.lit(1)).alias("n_folds"), F.count_if("over").alias("n_over")).withColumn("pbo", F.try_divide("n_over", "n_folds"))
    return out.withColumn("verdict", F.when(F.col("pbo").isNull(), "NOT_COMPUTABLE").when(F.col("pbo") < 0.5, "PASS").when(F.col("pbo") < 0.75, "WARN").otherwise("FAIL"))


def overfit_by_rank(scores: DataFrame) -> DataFrame:
    """The proper form. scores (fold_id, combo, is_score, oos_score): the best in-sample combination falls below the out-of-sample median."""
    w = Window.partitionBy("fold_id").orderBy(F.round("is_score", 9).desc(), "combo")
    best = scores.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("fold_id", "oos_score")
    mid = scores.groupBy("fold_id").agg(F.median("oos_score").alias("mid"))
    return _overfit(best.join(mid.hint("shuffle_merge"), "fold_id").withColumn("over", F.col("oos_score") < F.col("mid")))


def deflated_sharpe(daily: DataFrame, keys: Sequence[str], n_trials: int) -> DataFrame:
    """Observed daily Sharpe against the expected greatest of n_trials, with its standard error from skew and kurtosis."""
    from barloom.operators.metrics import sample_shape

    out = daily.groupBy(*keys).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s")).join(sample_shape(daily, keys, "ret").hint("shuffle_merge"), list(keys))
    log_n = math.log(n_trials) if n_trials > 1 else 0.0
    expected = math.sqrt(2 * log_n) * (1 - 0.5772156649 / (2 * log_n)) if n_trials > 1 else 0.0
    sr, n = F.try_divide("_m", "_s"), F.col("n").cast("double")
    out = out.withColumn("sr", sr)
    out = out.withColumn("se", F.sqrt((1 + 0.5 * F.col("sr") * F.col("sr") - F.col("skew") * F.col("sr") + F.col("excess_kurtosis") / 4 * F.col("sr") * F.col("sr")) / n))
    out = out.withColumn("z", F.try_divide(F.col("sr") - expected / F.sqrt(n), F.col("se")))
    out = _p_values(out, "z", None, "p_value").drop("_m", "_s")
    return out.withColumn("verdict", F.when(F.col("p_value") < 0.05, "PASS").when(F.col("p_value") < 0.10, "WARN").otherwise("FAIL"))


def t_test(rows: DataFrame, keys: Sequence[str], column: str, least: int = 5) -> DataFrame:
    """One-sided test of mean > 0; p is 1 for small groups."""
    out = rows.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    out = out.withColumns({"t_stat": F.try_divide("_m", F.col("_s") / F.sqrt(F.col("n").cast("double"))), "_df": F.greatest(F.col("n") - 1, F.lit(1))}).drop("_m", "_s")
    out = _p_values(out, "t_stat", "_df", "p").drop("_df")
    return out.withColumn("p_value", F.when(F.col("n") >= least, F.coalesce("p", F.lit(1.0))).otherwise(1.0)).drop("p")


def benjamini_hochberg(rows: DataFrame, p: str, alpha: float, tie: Sequence[str]) -> DataFrame:
    """reject: rank by p is at most the greatest rank k with p <= k alpha / n."""
    whole = Window.partitionBy(F.lit(0))
    out = rows.withColumns({"_k": F.row_number().over(whole.orderBy(p, *tie)), "_n": F.count(F.lit(1)).over(whole)})
    out = out.withColumn("_most", F.max(F.when(F.col(p) <= F.col("_k") * alpha / F.col("_n"), F.col("_k"))).over(whole))
    return out.withColumn("reject", F.coalesce(F.col("_k") <= F.col("_most"), F.lit(False))).drop("_k", "_n", "_most")



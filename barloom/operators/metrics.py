"""Trade and return metrics, grouped by any keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import meet
from barloom.operators.running import before, blocked, blocks_before, so_far


def winsorise(daily: DataFrame, bound: float = 0.40) -> DataFrame:
    """ret within bounds, with the sign of the side."""
    return daily.withColumn("ret", F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("ret"))) * F.when(F.col("side") == "SHORT", -1).otherwise(1))


def _running(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def additive_equity(trades: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """cum_ret, peak and drawdown; blocks of the order add up, so no task holds a key."""
    w, past = so_far(order), before(keys)
    rows = blocked(trades, keys, order).withColumn("_c", F.sum(pnl).over(w))
    facts = rows.groupBy("_g").agg(F.sum(pnl).alias("_sum"), F.max("_c").alias("_top"))
    facts = facts.withColumn("_cum", F.coalesce(F.sum("_sum").over(past), F.lit(0.0)))
    facts = facts.select("_g", F.when(F.count("_sum").over(past) > 0, F.col("_cum")).alias("_cum"), F.max(F.col("_cum") + F.col("_top")).over(past).alias("_peak"))
    rows = blocks_before(rows, facts).withColumn("cum_ret", F.when(F.col("_c").isNotNull(), F.coalesce("_cum", F.lit(0.0)) + F.col("_c")).otherwise(F.col("_cum")))
    rows = rows.withColumn("peak", F.greatest("_peak", F.max("cum_ret").over(w))).withColumn("drawdown", F.col("cum_ret") - F.col("peak"))
    return rows.drop("_g", "_c", "_cum", "_peak")


def _product(log: str, zero: str, minus: str) -> Column:
    """A product from the sum of logarithms, whether a factor is 0 and how many are negative; null without factors."""
    return F.when(F.col(zero) == 1, 0.0).otherwise(F.exp(log) * F.when(F.col(minus) % 2 == 1, -1).otherwise(1))


def compound_equity(trades: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """equity = product of 1 + r from a start of 1, its peak (the start counts) and relative drawdown.

    The product is a sum of logarithms, with the sign and zeros of 1 + r counted apart. Blocks of the order compose, so no task holds a key.
    """
    w, past, x = so_far(order), before(keys), 1 + F.col(pnl)
    parts = {"_log": F.sum(F.when(x != 0, F.log(F.abs(x)))), "_zero": F.max((x == 0).cast("int")), "_minus": F.sum((x < 0).cast("int"))}
    rows = blocked(trades, keys, order).withColumns({c: v.over(w) for c, v in parts.items()})
    own = rows.withColumn("_e", _product("_log", "_zero", "_minus"))
    facts = own.groupBy("_g").agg(*(v.alias(c) for c, v in parts.items()), F.max("_e").alias("_top"), F.min("_e").alias("_low"))
    facts = facts.select("_g", "_top", "_low", F.sum("_log").over(past).alias("_log0"), F.max("_zero").over(past).alias("_zero0"), F.sum("_minus").over(past).alias("_minus0"))
    start = F.when(F.col("_zero0").isNull(), 1.0).otherwise(F.coalesce(_product("_log0", "_zero0", "_minus0"), F.lit(1.0)))
    facts = facts.select("_g", "_log0", "_zero0", "_minus0", F.max(F.greatest(start * F.col("_top"), start * F.col("_low"))).over(past).alias("_peak"))
    rows = blocks_before(rows, facts)
    rows = rows.withColumns({
        "_log": F.when(F.col("_log").isNull(), F.col("_log0")).otherwise(F.col("_log") + F.coalesce("_log0", F.lit(0.0))), "_zero": F.greatest("_zero", "_zero0"),
        "_minus": F.when(F.col("_minus").isNull(), F.col("_minus0")).otherwise(F.col("_minus") + F.coalesce("_minus0", F.lit(0).cast("long"))),
    })
    rows = rows.withColumn("equity", _product("_log", "_zero", "_minus")).withColumn("peak", F.greatest(F.lit(1.0), "_peak", F.max("equity").over(w)))
    rows = rows.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("equity") - F.col("peak")) / F.col("peak")).otherwise(0.0))
    return rows.drop("_g", "_log", "_zero", "_minus", "_log0", "_zero0", "_minus0", "_peak")


def daily_pnl(trades: DataFrame, keys: Sequence[str], pnl: Column, day: str = "exit_time") -> DataFrame:
    return trades.groupBy(*keys, F.to_date(day).alias("day")).agg(F.sum(pnl).alias("pnl"))


def fill_calendar(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every day from a key's first to its last; missing ones with 0."""
    spans = daily.groupBy(*keys).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spans.join(daily.hint("shuffle_merge"), [*keys, "day"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def daily_returns(daily: DataFrame, keys: Sequence[str], capital: float, digits: int = 6) -> DataFrame:
    """ret = pnl / equity before (0 once nothing is left), equity being capital plus all pnl so far.

    Money is rounded to so many digits: what is left of an account after sums that nearly cancel is no noise of their last bits.
    """
    rows = daily.withColumn("equity", F.round(capital + F.sum("pnl").over(_running(keys, ["day"])), digits)).withColumn("pnl", F.round("pnl", digits))
    before = F.round(F.col("equity") - F.col("pnl"), digits)
    rows = rows.withColumn("ret", F.when(before > 0, F.col("pnl") / before).otherwise(0.0))
    rows = rows.withColumn("peak", F.greatest(F.lit(float(capital)), F.max("equity").over(_running(keys, ["day"]))))
    return rows.withColumn("dd", F.when(F.col("peak") > 0, (F.col("equity") - F.col("peak")) / F.col("peak")).otherwise(0.0))


def rolling_mean(daily: DataFrame, keys: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    def mean(n: int) -> Column:
        w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-(n - 1), 0)
        return F.when(F.count("ret").over(w) == n, F.avg("ret").over(w))

    return daily.withColumns({f"mean_{n}": mean(n) for n in sizes})


def streaks(trades: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """Longest runs of wins and of losses; a zero ends both.

    Runs are counted in blocks of the order; then only each block's first and last one meet those of its neighbours.
    """
    w = Window.partitionBy("_g").orderBy(*order)
    rows = blocked(trades, keys, order).withColumn("_s", F.signum(pnl).cast("int")).withColumn("_new", F.coalesce(F.col("_s") != F.lag("_s").over(w), F.lit(True)).cast("int"))
    runs = rows.withColumn("_run", F.sum("_new").over(so_far(order))).groupBy("_g", "_run", "_s").agg(F.count(F.lit(1)).alias("n"))
    best = lambda sign, name: F.max(F.when(sign, F.col("n"))).alias(name)
    run = F.struct("_s", "n")
    facts = runs.groupBy("_g").agg(F.max("_run").alias("_runs"), F.min_by(run, "_run").alias("_first"), F.max_by(run, "_run").alias("_last"), best(F.col("_s") > 0, "_wins"), best(F.col("_s") < 0, "_losses"))
    own = [F.col("_g")[k].alias(k) for k in keys]
    ends = facts.select("_g", F.posexplode(F.when(F.col("_runs") > 1, F.array("_first", "_last")).otherwise(F.array("_first"))).alias("_at", "_r")).select(*own, F.col("_g")["_b"].alias("_b"), "_at", "_r._s", "_r.n")
    line = Window.partitionBy(*keys).orderBy("_b", "_at")
    ends = ends.withColumn("_new", ((F.col("_at") == 1) | F.coalesce(F.col("_s") != F.lag("_s").over(line), F.lit(True))).cast("int"))
    ends = ends.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run", "_s").agg(F.sum("n").alias("n"))
    whole = ends.groupBy(*keys).agg(best(F.col("_s") > 0, "_wins"), best(F.col("_s") < 0, "_losses")).unionByName(facts.select(*own, "_wins", "_losses"))
    return whole.groupBy(*keys).agg(F.coalesce(F.max("_wins"), F.lit(0)).alias("max_wins"), F.coalesce(F.max("_losses"), F.lit(0)).alias("max_losses"))


def profit_factor(pnl: str) -> Column:
    x = F.col(pnl)
    return F.coalesce(F.try_divide(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x)))), F.lit(0.0))


def trade_metrics(trades: DataFrame, keys: Sequence[str], pnl: str, notional: float = 1.0) -> DataFrame:
    x = F.col(pnl)
    payoff = F.try_divide(F.avg(F.when(x > 0, x)), F.abs(F.avg(F.when(x < 0, x))))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), profit_factor(pnl).alias("profit_factor"), F.avg((x > 0).cast("double")).alias("win_rate"), F.coalesce(payoff, F.lit(0.0)).alias("payoff"),
        F.avg(x).alias("expectancy"), (F.avg(x) * notional).alias("expectancy_usd"), F.avg("hold_bars").alias("avg_bars"),
    )


def kpi_row(trades: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str, n_bars: int, bars_per_year: int) -> DataFrame:
    """Counts, compound return, CAGR, daily Sharpe, Sortino, Calmar, drawdown, hit rate, expectancy, profit factor, turnover, exposure."""
    curve = compound_equity(trades, keys, order, pnl)
    x = F.col(pnl)
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    out = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.min("drawdown").alias("mdd"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.avg(x).alias("expectancy"), profit_factor(pnl).alias("profit_factor"),
        F.coalesce(F.try_divide(F.avg(x), down) * F.sqrt(F.lit(float(bars_per_year))), F.lit(0.0)).alias("sortino"), (F.count(F.lit(1)) / n_bars).alias("turnover"), (F.sum("hold_bars") / n_bars).alias("exposure"),
        F.max_by("equity", F.struct(*order)).alias("final"),
    )
    out = out.withColumn("mdd", F.least(F.lit(0.0), F.col("mdd"))).withColumn("total_return", F.col("final") - 1)
    out = out.withColumn("cagr", F.when(F.col("final") > 0, F.pow("final", F.lit(bars_per_year / n_bars)) - 1).otherwise(-1.0))
    return out.withColumn("calmar", F.coalesce(F.try_divide("total_return", F.abs("mdd")), F.lit(0.0))).join(sharpe_by_day(trades, keys, pnl).hint("shuffle_merge"), list(keys))


def sharpe_by_day(trades: DataFrame, keys: Sequence[str], pnl: str, year: int = 252) -> DataFrame:
    daily = daily_pnl(trades, keys, F.col(pnl))
    return daily.groupBy(*keys).agg(F.coalesce(F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * F.sqrt(F.lit(float(year))), F.lit(0.0)).alias("sharpe"))


def core_metrics(daily: DataFrame, keys: Sequence[str], capital: float, year: int = 365) -> DataFrame:
    """Sharpe, Sortino (all days), CAGR, drawdown, Calmar and Ulcer index of a calendar-filled series of daily_returns()."""
    out = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.max_by("equity", "day").alias("final"), F.avg("ret").alias("mean_ret"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("std_ret"),
        F.sqrt(F.avg(F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2.0)))).alias("down"), F.least(F.lit(0.0), F.min("dd")).alias("mdd"), F.least(F.lit(0.0), F.min(F.col("equity") - F.col("peak"))).alias("mdd_usd"),
        F.sqrt(F.sum(F.pow(F.col("dd") * 100, F.lit(2.0))) / (F.count(F.lit(1)) + 1)).alias("ulcer"),
    )
    root = F.sqrt(F.lit(float(year)))
    out = out.withColumns({
        "total_return_pct": (F.col("final") / capital - 1) * 100, "sharpe": F.coalesce(F.try_divide("mean_ret", "std_ret") * root, F.lit(0.0)), "sortino": F.coalesce(F.try_divide("mean_ret", "down") * root, F.lit(0.0)),
        "cagr": F.when(F.col("final") > 0, F.pow(F.col("final") / capital, year / F.col("days")) - 1).otherwise(-1.0),
    })
    return out.withColumn("calmar", F.coalesce(F.try_divide("cagr", F.abs("mdd")), F.lit(0.0)))


def sample_shape(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Skewness and excess kurtosis corrected for bias (from 3 and 4 values).

    Equal values are counted first: one by one, many of them (the zeros after a ruin) would all be rounded the same way beside one large value.
    """
    n, x, c = F.col("n").cast("double"), F.col(column), F.when(F.col(column).isNotNull(), F.col("_c"))
    w = Window.partitionBy(*keys)
    values = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    values = values.withColumn("_d", x - F.sum(c * x).over(w) / F.sum(c).over(w))
    d2 = F.col("_d") * F.col("_d")
    out = values.groupBy(*keys).agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.when(F.count(column) > 1, F.sum(c * d2)).alias("_2"), F.sum(c * d2 * F.col("_d")).alias("_3"), F.sum(c * d2 * d2).alias("_4"))
    out = out.withColumns({"_s": F.try_divide(F.sqrt(n) * F.col("_3"), F.pow("_2", F.lit(1.5))), "_k": F.try_divide(n * F.col("_4"), F.col("_2") * F.col("_2")) - 3}).drop("_2", "_3", "_4")
    return out.withColumns({
        "skew": F.when(n >= 3, F.col("_s") * F.sqrt(n * (n - 1)) / (n - 2)), "excess_kurtosis": F.when(n >= 4, ((n + 1) * F.col("_k") + 6) * (n - 1) / ((n - 2) * (n - 3))),
    }).drop("_s", "_k")


def tail_ratio(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """|p95| / |p05|, from 20 values."""
    out = rows.groupBy(*keys).agg(F.count(column).alias("n"), F.percentile(column, F.lit(0.95)).alias("_a"), F.percentile(column, F.lit(0.05)).alias("_b"))
    return out.withColumn("tail_ratio", F.when(F.col("n") >= 20, F.coalesce(F.try_divide(F.abs("_a"), F.abs("_b")), F.lit(0.0)))).drop("_a", "_b")


def value_at_risk(rows: DataFrame, keys: Sequence[str], column: str, alpha: float = 0.05) -> DataFrame:
    """The value of rank floor(n alpha) from below (0 is the least), and the mean up to it."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(column)) - 1, "_n": F.count(F.lit(1)).over(w)})
    k = F.floor(F.col("_n") * F.lit(alpha))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == k, F.col(column))).alias("var"), F.avg(F.when(F.col("_r") <= k, F.col(column))).alias("cvar"))


def fold_metrics(trades: DataFrame, pnl: str) -> DataFrame:
    x = F.col(pnl)
    out = trades.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.avg((x > 0).cast("double")).alias("win_rate"), profit_factor(pnl).alias("profit_factor"))
    return out.withColumn("positive", F.col("total") > 0).withColumn("pass_rate", F.avg(F.col("positive").cast("double")).over(Window.partitionBy(F.lit(0))))


def cost_multiples(trades: DataFrame, multiples: Sequence[float], cost: float) -> DataFrame:
    """Every trade under each multiple of the cost, as net; the multiple becomes one more key."""
    rows = trades.withColumn("multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    return rows.withColumn("net", F.col("gross_pnl") - cost * F.col("multiple"))


def cost_sensitivity(trades: DataFrame, multiples: Sequence[float], cost: float, notional: float, capital: float) -> DataFrame:
    rows = cost_multiples(trades, multiples, cost)
    daily = daily_returns(fill_calendar(daily_pnl(rows, ["multiple"], F.col("net") * notional), ["multiple"]), ["multiple"], capital)
    out = core_metrics(daily, ["multiple"], capital).select("multiple", "sharpe", "total_return_pct", (F.col("mdd") * 100).alias("mdd_pct"))
    own = rows.groupBy("multiple").agg(F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), profit_factor("net").alias("profit_factor"), F.coalesce(F.try_divide(F.sum("gross_pnl"), F.count(F.lit(1)) * cost), F.lit(0.0)).alias("breakeven"))
    return out.join(own.hint("shuffle_merge"), "multiple").withColumn("investable", (F.col("sharpe") > 0) & (F.col("total_return_pct") > 0) & (F.col("mdd_pct") > -25))


def alpha_report(signals: DataFrame, horizons: Sequence[int], base: float, stress: float, least: int = 5) -> DataFrame:
    """By symbol, fold, side, part and horizon: mean, deviation, net means, sharpe and win rate of fwd_h; small groups are left out."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("ret")) for h in horizons])
    rows = signals.withColumn("_p", F.explode(pairs)).select("symbol", "fold_id", "side", "segment", "_p.horizon", "_p.ret").where("ret is not null")
    out = rows.groupBy("symbol", "fold_id", "side", "segment", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))
    out = out.where(F.col("n") >= least)
    return out.withColumns({"net_base": F.col("mean_ret") - base, "net_stress": F.col("mean_ret") - stress, "sharpe_like": F.try_divide("mean_ret", "std_ret")})


def alpha_design(report: DataFrame, least: int = 80, confirm_share: float = 0.1) -> DataFrame:
    """Best horizon of each symbol and side among groups that are large and pay, with the targets that follow from it."""
    rows = report.where((F.col("n") >= least) & (F.col("net_base") >= 0)).withColumn("score", F.col("sharpe_like") * F.sqrt("n"))
    w = Window.partitionBy("symbol", "side").orderBy(F.round("score", 9).desc(), "horizon", "fold_id", "segment")
    best = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    h = F.col("horizon")
    whole = lambda least, share: F.greatest(F.lit(least), F.floor(h * F.lit(share)).cast("int"))
    return best.withColumns({"time_stop": h, "min_hold_bars": whole(6, 0.25), "confirm_bars": whole(3, confirm_share)})


def edge_summary(rows: DataFrame, ret: str, horizon: int) -> DataFrame:
    """One pass over GROUPING SETS: overall, by side, symbol and side, regime, segment."""
    view = f"edges_{ret}_{horizon}"
    rows.createOrReplaceTempView(view)
    return rows.sparkSession.sql(f"""
        SELECT side, symbol, regime, segment, count({ret}) AS n, avg({ret}) AS mean_ret, median({ret}) AS median_ret, 100 * avg(CAST({ret} > 0 AS DOUBLE)) AS positive_pct,
          coalesce(try_divide(avg({ret}), stddev_samp({ret})) * sqrt(252 * 288 / {horizon}D), 0.0D) AS sharpe
        FROM {view} WHERE {ret} IS NOT NULL GROUP BY GROUPING SETS ((), (side), (symbol, side), (regime), (segment))""")


def best_horizon(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The horizon of the greatest mean; of equal ones the smallest."""
    return report.groupBy(*keys).agg(F.max_by("horizon", F.struct(F.round("mean_ret", 12), -F.col("horizon"))).alias("best_horizon"), F.max(F.round("mean_ret", 12)).alias("best_mean"))


def timing_qa(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds from signal to entry and of holding: median, p90, p99, most, and how many are slow."""
    from barloom.functions.ranks import nearest_ranks

    rows = trades.withColumns({"_wait": F.unix_timestamp("entry_time") - F.unix_timestamp("signal_time"), "_hold": F.unix_timestamp("exit_time") - F.unix_timestamp("entry_time")})
    out = rows.groupBy(*keys).agg(F.median("_wait").alias("wait_p50"), F.max("_wait").alias("wait_max"), F.median("_hold").alias("hold_p50"), F.max("_hold").alias("hold_max"), *[F.avg((F.col("_hold") > s).cast("double")).alias(f"hold_over_{s}") for s in (900, 3600, 86400)])
    ranks = nearest_ranks(rows, keys, {f"_{c}": {f"{c}_p90": 0.90, f"{c}_p99": 0.99} for c in ("wait", "hold")})
    return out.join(ranks.hint("shuffle_merge"), list(keys))


def decay_table(report: DataFrame, keys: Sequence[str] = ("symbol", "side"), top: int = 20) -> DataFrame:
    """In-sample edge beside the out-of-sample one, with the change in percent; the best by the latter."""
    wide = report.groupBy(*keys).agg(F.max(F.when(F.col("segment") == "IS", F.col("edge"))).alias("edge_is"), F.max(F.when(F.col("segment") == "OOS", F.col("edge"))).alias("edge_oos")).where("edge_is is not null and edge_oos is not null")
    wide = wide.withColumn("decay_pct", F.when(F.abs("edge_is") > 0.01, (F.col("edge_oos") - F.col("edge_is")) / F.abs("edge_is") * 100).otherwise(0.0))
    return wide.orderBy(F.col("edge_oos").desc(), *keys).limit(top)


def common_days(daily: DataFrame) -> DataFrame:
    """Rows of the days on which every symbol has one."""
    total = daily.agg(F.countDistinct("symbol").alias("total"))
    days = daily.groupBy("day").agg(F.countDistinct("symbol").alias("n")).join(F.broadcast(total)).where("n = total").select("day")
    return daily.join(days.hint("shuffle_merge"), "day", "left_semi")


TILE, DAYS = 256, 256
"""Symbols in a tile, on average, and days in a block of the matrix product."""


def correlations(daily: DataFrame, tile: int = TILE, days: int = DAYS) -> DataFrame:
    """Pearson correlation of daily returns of every pair of symbols, and on how many days both have a row.

    daily: one row for each (symbol, day). A blocked matrix product: symbols lie in tiles, days in blocks; each block of a tile
    is sent once to each pair of tiles that it belongs to, where sums and cross-products of all its pairs come from products of
    matrices, with masks for what is missing. So rows move once for each tile, not once for each other symbol.
    Returns are taken from their symbol's mean, which changes no correlation and keeps the sums small; days on which one of both is null don't
    count in rho, and a pair without variation has a null.
    """
    daily = daily.where("symbol IS NOT NULL")
    symbols = daily.groupBy("symbol").agg(F.avg("ret").alias("_mean"))
    tiles = max(1, -(-symbols.count() // tile))
    place = F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int")
    rows = meet(daily.select("symbol", "day", F.col("ret").cast("double").alias("ret")), symbols, ["symbol"])
    rows = rows.select("symbol", F.datediff("day", F.lit("1970-01-01")).cast("long").alias("_d"), (F.col("ret") - F.col("_mean")).alias("x"), place.alias("_tile"))
    rows = rows.withColumn("_block", F.floor(F.col("_d") / days)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    sums = ("days", "n", "sx", "sy", "sxx", "syy", "sxy")

    def work(table: pa.Table) -> pa.Table:
        names, at = np.unique(np.array(table["symbol"].to_pylist(), object).astype(str), return_inverse=True)
        own = np.zeros(len(names), np.int64)
        own[at] = table["_tile"].to_numpy()
        _, day = np.unique(table["_d"].to_numpy(), return_inverse=True)
        value = table["x"].to_numpy(zero_copy_only=False)
        x, here, known = (np.zeros((day.max() + 1, len(names))) for _ in range(3))
        there = ~np.isnan(value)
        here[day, at], known[day[there], at[there]], x[day[there], at[there]] = 1, 1, value[there]
        square = x * x
        product = {"days": here.T @ here, "n": known.T @ known, "sx": x.T @ known, "sy": known.T @ x, "sxx": square.T @ known, "syy": known.T @ square, "sxy": x.T @ x}
        low, high = int(table["_low"][0].as_py()), int(table["_high"][0].as_py())
        wanted = np.triu(np.ones((len(names), len(names)), bool), 1) & (product["days"] > 0)
        if low != high:  # pairs inside of a tile are counted with the tile itself
            wanted &= own[:, None] != own[None, :]
        a, b = np.nonzero(wanted)
        return pa.table({"a": pa.array(names[a], pa.string()), "b": pa.array(names[b], pa.string())} | {k: pa.array(product[k][a, b]) for k in sums})

    pairs = rows.withColumns({"_low": F.least("_tile", "_other"), "_high": F.greatest("_tile", "_other")}).groupBy("_block", "_low", "_high").applyInArrow(work, "a string, b string, " + ", ".join(f"{k} double" for k in sums))
    whole = pairs.groupBy("a", "b").agg(*(F.sum(k).alias(k) for k in sums))
    spread = lambda s, ss: F.greatest(F.col("n") * F.col(ss) - F.col(s) * F.col(s), F.lit(0.0))
    rho = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sx", "sxx") * spread("sy", "syy")))
    return whole.select("a", "b", rho.alias("rho"), F.col("days").cast("long").alias("days"))


def joint_losses(daily: DataFrame) -> DataFrame:
    """Share of days with k symbols or more below zero, with the worst and best day."""
    days = daily.groupBy("day").agg(F.count_if(F.col("ret") < 0).alias("losers"), F.sum("ret").alias("total"), F.count(F.lit(1)).alias("symbols"))
    facts = days.agg(F.count(F.lit(1)).alias("days"), F.min("total").alias("worst"), F.max("total").alias("best"), F.max("symbols").alias("most"))
    ks = days.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest("losers", F.lit(1)).cast("int")))).where("losers >= k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return ks.join(F.broadcast(facts)).select("k", F.round(100.0 * F.col("n") / F.col("days"), 6).alias("share_pct"), F.round("worst", 9).alias("worst"), F.round("best", 9).alias("best"))


def position_limit(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Average, least and greatest correlation, of a group too, and how many positions may stand at once."""
    inside = F.col("a").isin(*group) & F.col("b").isin(*group) if group else F.lit(False)
    out = pairs.agg(F.avg("rho").alias("avg_rho"), F.max("rho").alias("max_rho"), F.min("rho").alias("min_rho"), F.coalesce(F.avg(F.when(inside, F.col("rho"))), F.lit(0.0)).alias("group_rho"))
    return out.withColumn("max_positions", F.when(F.col("max_rho") >= 0.60, 1).when(F.col("avg_rho") >= 0.20, 2).otherwise(3))


def class_rollup(rows: DataFrame) -> DataFrame:
    """By asset class: symbols, significant ones, mean edge, best symbol."""
    return rows.groupBy("asset_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("significant").alias("n_significant"), F.avg("edge").alias("mean_edge"), F.max_by("symbol", F.struct("edge", "symbol")).alias("best"))


def score_counts(tuning: DataFrame) -> DataFrame:
    """How many different scores a symbol's fold has, and whether the grid changes anything."""
    out = tuning.groupBy("symbol", "fold_id").agg(F.countDistinct(F.round("score", 9)).alias("scores"), F.count(F.lit(1)).alias("combos"))
    return out.withColumn("varies", (F.col("scores") > 1) | (F.col("combos") < 2))


def side_mismatch(alpha: DataFrame, traded: DataFrame) -> DataFrame:
    """The side of the best alpha beside the side that traded best. alpha: symbol, side, score; traded: symbol, side, total."""
    best = lambda df, c, name: df.groupBy("symbol").agg(F.max_by("side", F.struct(F.round(c, 9), "side")).alias(name), F.max(F.round(c, 9)).alias(c))
    return best(alpha, "score", "alpha_side").join(best(traded, "total", "traded_side").hint("shuffle_merge"), "symbol").withColumn("mismatch", F.col("alpha_side") != F.col("traded_side"))


# Metric, pass and warn bounds, direction.
THRESHOLDS = (
    ("n_trades", 30.0, 15.0, "gt"), ("total_return_pct", 0.0, -5.0, "gt"), ("sharpe_annual", 0.50, 0.0, "gt"), ("sortino_annual", 0.70, 0.0, "gt"), ("calmar", 0.50, 0.0, "gt"),
    ("max_dd_pct", -10.0, -20.0, "gt"), ("ulcer_index", 5.0, 10.0, "lt"), ("profit_factor", 1.50, 1.0, "gt"), ("win_rate", 0.40, 0.20, "gt"), ("expectancy_usd", 50.0, 0.0, "gt"),
)


def verdicts(metrics: DataFrame) -> DataFrame:
    """metrics (metric, value) with PASS, WARN or FAIL; N/A for one without bounds."""
    limits = metrics.sparkSession.createDataFrame(list(THRESHOLDS), "metric string, pass double, warn double, dir string")
    rows = metrics.join(F.broadcast(limits), "metric", "left")
    sign = F.when(F.col("dir") == "lt", -1).otherwise(1)
    v = sign * F.col("value")
    verdict = F.when(F.col("dir").isNull(), "N/A").when(F.col("value").isNull() | F.isnan("value"), "FAIL").when(v >= sign * F.col("pass"), "PASS").when(v >= sign * F.col("warn"), "WARN").otherwise("FAIL")
    return rows.withColumn("verdict", verdict).drop("pass", "warn", "dir")


def overall(rows: DataFrame) -> DataFrame:
    """Counts of verdicts; the worst one wins."""
    count = lambda v: F.count_if(F.startswith(F.col("verdict"), F.lit(v)))
    out = rows.agg(count("PASS").alias("n_pass"), count("WARN").alias("n_warn"), count("FAIL").alias("n_fail"))
    return out.withColumn("overall", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"))

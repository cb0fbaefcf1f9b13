"""Queries over metrics, tests and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import metrics as M
from barloom.operators import resample as R
from barloom.operators import stats as S
from barloom.plans.bar_queries import day
from barloom.plans.registry import query
from barloom.plans.trade_queries import ORDER, RULES, _replay_sql, _replayed, by_entry_day
from barloom.sources import fixtures as X
from barloom.sources.fixtures import SQL_TRADES, TRADE_ORDER

CAPITAL, NOTIONAL = 1_000_000.0, 1000.0
PART = f"PARTITION BY symbol, side ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ID = ["k1", "k2", "k3", "k4", "k5"]
IDS = "k1, k2, k3, k4, k5"


@query("W16_additive_equity", SQL_TRADES, sql=f"SELECT symbol, side, {IDS}, round(c, 6) AS cum_ret, round(c - max(c) OVER ({PART}), 6) AS drawdown FROM (SELECT *, sum(net_pnl_base) OVER ({PART}) AS c FROM trades)")
def w16(spark, folder):
    rows = M.additive_equity(X.trades(spark, folder), ["symbol", "side"], TRADE_ORDER, "net_pnl_base")
    return rows.select("symbol", "side", *ID, F.round("cum_ret", 6).alias("cum_ret"), F.round("drawdown", 6).alias("drawdown"))


SCALED = SQL_TRADES + f""",
ce AS (SELECT *, exp(sum(ln(1 + net_pnl_base / 10)) OVER ({PART})) AS equity FROM trades),
cd AS (SELECT *, equity / greatest(1, max(equity) OVER ({PART})) - 1 AS drawdown FROM ce)"""


def scaled(spark, folder) -> DataFrame:
    return X.trades(spark, folder).withColumn("r", F.col("net_pnl_base") / 10)


@query("W17_compound_equity", SCALED, sql=f"SELECT symbol, side, {IDS}, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM cd")
def w17(spark, folder):
    rows = M.compound_equity(scaled(spark, folder), ["symbol", "side"], TRADE_ORDER, "r")
    return rows.select("symbol", "side", *ID, F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


DAILY = SQL_TRADES + f""",
dp AS (SELECT symbol, side, CAST(exit_time AS DATE) AS d, sum(net_pnl_base * {NOTIONAL}) AS pnl FROM trades GROUP BY ALL),
cal AS (SELECT symbol, side, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM dp GROUP BY symbol, side),
df AS (SELECT symbol, side, d, coalesce(pnl, 0) AS pnl FROM cal LEFT JOIN dp USING (symbol, side, d)),
de AS (SELECT symbol, side, d, round(pnl, 6) AS pnl, round({CAPITAL} + sum(pnl) OVER (PARTITION BY symbol, side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS equity FROM df),
dr AS (SELECT *, CASE WHEN round(equity - pnl, 6) > 0 THEN pnl / round(equity - pnl, 6) ELSE 0 END AS ret, greatest({CAPITAL}, max(equity) OVER (PARTITION BY symbol, side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM de),
dd AS (SELECT *, (equity - peak) / peak AS dd FROM dr)"""  # fmt: skip
KEYS = ["symbol", "side"]


def filled(spark, folder) -> DataFrame:
    return M.fill_calendar(M.daily_pnl(X.trades(spark, folder), KEYS, F.col("net_pnl_base") * NOTIONAL), KEYS)


def daily(spark, folder) -> DataFrame:
    return M.daily_returns(filled(spark, folder), KEYS, CAPITAL)


@query("A26_daily_pnl", DAILY, sql="SELECT symbol, side, CAST(epoch(d) AS BIGINT) AS d, round(pnl, 6) AS pnl FROM dp")
def a26(spark, folder):
    return M.daily_pnl(X.trades(spark, folder), KEYS, F.col("net_pnl_base") * NOTIONAL).select(*KEYS, day().alias("d"), F.round("pnl", 6).alias("pnl"))


@query("J10_calendar_fill", DAILY, sql="SELECT symbol, side, CAST(epoch(d) AS BIGINT) AS d, round(pnl, 6) AS pnl FROM df")
def j10(spark, folder):
    return filled(spark, folder).select(*KEYS, day().alias("d"), F.round("pnl", 6).alias("pnl"))


@query("W18_daily_returns", DAILY, sql="SELECT symbol, side, CAST(epoch(d) AS BIGINT) AS d, round(ret, 9) AS ret, round(equity, 4) AS equity FROM dr")
def w18(spark, folder):
    return daily(spark, folder).select(*KEYS, day().alias("d"), F.round("ret", 9).alias("ret"), F.round("equity", 4).alias("equity"))


def _mean(n: int) -> str:
    w = f"(PARTITION BY symbol, side ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(ret) OVER {w} = {n} THEN round(avg(ret) OVER {w}, 9) END AS mean_{n}"


@query("W19_rolling_mean", DAILY, sql=f"SELECT symbol, side, CAST(epoch(d) AS BIGINT) AS d, {_mean(30)}, {_mean(60)}, {_mean(90)} FROM dr")
def w19(spark, folder):
    rows = M.rolling_mean(daily(spark, folder), KEYS, (30, 60, 90))
    return rows.select(*KEYS, day().alias("d"), *[F.round(f"mean_{n}", 9).alias(f"mean_{n}") for n in (30, 60, 90)])


@query("W20_streaks", SQL_TRADES, sql=f"SELECT symbol, side, CAST(coalesce(max(n) FILTER (s > 0), 0) AS BIGINT) AS max_wins, CAST(coalesce(max(n) FILTER (s < 0), 0) AS BIGINT) AS max_losses FROM (SELECT symbol, side, run, s, count(*) AS n FROM (SELECT *, sum(CAST(s IS DISTINCT FROM p AS INT)) OVER ({PART}) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY symbol, side ORDER BY {ORDER}) AS p FROM (SELECT *, CAST(sign(gross_pnl) AS INT) AS s FROM trades))) GROUP BY ALL) GROUP BY symbol, side")
def w20(spark, folder):
    return M.streaks(X.trades(spark, folder), KEYS, TRADE_ORDER, "gross_pnl")


PF = "coalesce(sum({0}) FILTER ({0} > 0) / abs(sum({0}) FILTER ({0} < 0)), 0)"


@query("A24_trade_summary", SQL_TRADES, sql="SELECT symbol, fold_id, segment, side, CAST(count(*) AS BIGINT) AS n, round(sum(net_pnl_base), 6) AS total, round(avg(net_pnl_base), 9) AS mean, round(avg(CAST(net_pnl_base > 0 AS DOUBLE)), 6) AS win_rate, round(avg(hold_bars), 6) AS hold FROM trades GROUP BY ALL")
def a24(spark, folder):
    x = F.col("net_pnl_base")
    return X.trades(spark, folder).groupBy("symbol", "fold_id", "segment", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 6).alias("total"), F.round(F.avg(x), 9).alias("mean"), F.round(F.avg((x > 0).cast("double")), 6).alias("win_rate"), F.round(F.avg("hold_bars"), 6).alias("hold"))


@query("A25_exit_reasons", SQL_TRADES, sql="SELECT symbol, exit_reason, CAST(count(*) AS BIGINT) AS n FROM trades GROUP BY ALL")
def a25(spark, folder):
    return X.trades(spark, folder).groupBy("symbol", "exit_reason").agg(F.count(F.lit(1)).alias("n"))


@query("A22_timing_qa", SQL_TRADES, sql="SELECT symbol, segment, median(w) AS wait_p50, max(w) AS wait_max, median(h) AS hold_p50, max(h) AS hold_max, round(avg(CAST(h > 900 AS DOUBLE)), 9) AS hold_over_900, round(avg(CAST(h > 3600 AS DOUBLE)), 9) AS hold_over_3600, round(avg(CAST(h > 86400 AS DOUBLE)), 9) AS hold_over_86400, " + ", ".join(f"CAST(list_sort(list({c}))[CAST(round((count(*) - 1) * {q}::DOUBLE) AS INT) + 1] AS DOUBLE) AS {n}_p{p}" for c, n in (("w", "wait"), ("h", "hold")) for q, p in ((0.90, 90), (0.99, 99))) + " FROM (SELECT symbol, segment, CAST(epoch(entry_time) - epoch(signal_time) AS BIGINT) AS w, CAST(epoch(exit_time) - epoch(entry_time) AS BIGINT) AS h FROM trades) GROUP BY ALL")
def a22(spark, folder):
    out = M.timing_qa(X.trades(spark, folder), ["symbol", "segment"])
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("hold_over")})


@query("M1_kpi_row", SCALED, sql=f"""SELECT symbol, side, CAST(n AS BIGINT) AS n_trades, round(mdd, 6) AS mdd, round(hit, 6) AS hit_rate, round(ex, 9) AS expectancy, round(pf, 6) AS profit_factor, round(so, 6) AS sortino, round(n / 100000.0::DOUBLE, 9) AS turnover, round(h / 100000.0::DOUBLE, 9) AS exposure, round(f - 1, 6) AS total_return, round(pow(f, 8760 / 100000.0::DOUBLE) - 1, 6) AS cagr, round(coalesce((f - 1) / nullif(abs(mdd), 0), 0), 4) AS calmar, round(sharpe, 6) AS sharpe FROM
(SELECT symbol, side, count(*) AS n, least(0, min(drawdown)) AS mdd, avg(CAST(net_pnl_base > 0 AS DOUBLE)) AS hit, avg(net_pnl_base / 10) AS ex, {PF.format('(net_pnl_base / 10)')} AS pf, avg(net_pnl_base / 10) / sqrt(avg(pow(net_pnl_base / 10, 2)) FILTER (net_pnl_base < 0)) * sqrt(8760) AS so, sum(hold_bars) AS h, last(equity ORDER BY {ORDER}) AS f FROM cd GROUP BY ALL)
JOIN (SELECT symbol, side, avg(p) / stddev_samp(p) * sqrt(252) AS sharpe FROM (SELECT symbol, side, CAST(exit_time AS DATE) AS d, sum(net_pnl_base / 10) AS p FROM trades GROUP BY ALL) GROUP BY ALL) USING (symbol, side)""")  # fmt: skip
def m1(spark, folder):
    out = M.kpi_row(scaled(spark, folder), KEYS, TRADE_ORDER, "r", 100_000, 8760)
    digits = {"mdd": 6, "hit_rate": 6, "expectancy": 9, "profit_factor": 6, "sortino": 6, "turnover": 9, "exposure": 9, "total_return": 6, "cagr": 6, "calmar": 4, "sharpe": 6}
    return out.select(*KEYS, "n_trades", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("M2_sharpe_by_day", SQL_TRADES, sql="SELECT symbol, side, round(avg(p) / stddev_samp(p) * sqrt(252), 6) AS sharpe FROM (SELECT symbol, side, CAST(exit_time AS DATE) AS d, sum(net_pnl_base) AS p FROM trades GROUP BY ALL) GROUP BY ALL")
def m2(spark, folder):
    return M.sharpe_by_day(X.trades(spark, folder), KEYS, "net_pnl_base").withColumn("sharpe", F.round("sharpe", 6))


@query("M3_core_metrics", DAILY, sql=f"""SELECT symbol, side, CAST(n AS BIGINT) AS days, round(f, 4) AS final, round((f / {CAPITAL} - 1) * 100, 6) AS total_return_pct, round(coalesce(m / nullif(s, 0), 0) * sqrt(365), 6) AS sharpe, round(coalesce(m / nullif(dn, 0), 0) * sqrt(365), 6) AS sortino, round(cagr, 9) AS cagr, round(mdd, 9) AS mdd, round(musd, 4) AS mdd_usd, round(coalesce(cagr / nullif(abs(mdd), 0), 0), 6) AS calmar, round(u, 6) AS ulcer FROM
(SELECT *, CASE WHEN f > 0 THEN pow(f / {CAPITAL}, 365.0::DOUBLE / n) - 1 ELSE -1 END AS cagr FROM (SELECT symbol, side, count(*) AS n, last(equity ORDER BY d) AS f, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(pow(least(ret, 0), 2))) AS dn, least(0, min(dd)) AS mdd, least(0, min(equity - peak)) AS musd, sqrt(sum(pow(dd * 100, 2)) / (count(*) + 1)) AS u FROM dd GROUP BY ALL))""")  # fmt: skip
def m3(spark, folder):
    out = M.core_metrics(daily(spark, folder), KEYS, CAPITAL)
    digits = {"final": 4, "total_return_pct": 6, "sharpe": 6, "sortino": 6, "cagr": 9, "mdd": 9, "mdd_usd": 4, "calmar": 6, "ulcer": 6}
    return out.select(*KEYS, "days", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("M4_sample_shape", DAILY, sql="SELECT symbol, side, CAST(count(ret) AS BIGINT) AS n, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS excess_kurtosis FROM dr GROUP BY ALL")
def m4(spark, folder):
    out = M.sample_shape(daily(spark, folder), KEYS, "ret")
    return out.select(*KEYS, "n", F.round("skew", 6).alias("skew"), F.round("excess_kurtosis", 6).alias("excess_kurtosis"))


@query("M5_tail_ratio", DAILY, sql="SELECT symbol, side, CAST(count(ret) AS BIGINT) AS n, round(CASE WHEN count(ret) >= 20 THEN coalesce(abs(quantile_cont(ret, 0.95)) / nullif(abs(quantile_cont(ret, 0.05)), 0), 0) END, 6) AS tail_ratio FROM dr GROUP BY ALL")
def m5(spark, folder):
    return M.tail_ratio(daily(spark, folder), KEYS, "ret").withColumn("tail_ratio", F.round("tail_ratio", 6))


@query("M6_value_at_risk", DAILY, sql="SELECT symbol, side, round(max(ret) FILTER (r = k), 9) AS var, round(avg(ret) FILTER (r <= k), 9) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY ret) - 1 AS r, floor(count(*) OVER (PARTITION BY symbol, side) * 0.05::DOUBLE) AS k FROM dr) GROUP BY ALL")
def m6(spark, folder):
    return M.value_at_risk(daily(spark, folder), KEYS, "ret").select(*KEYS, F.round("var", 9).alias("var"), F.round("cvar", 9).alias("cvar"))


@query("M7_trade_metrics", SQL_TRADES, sql=f"SELECT symbol, side, CAST(count(*) AS BIGINT) AS n_trades, round({PF.format('net_pnl_base')}, 6) AS profit_factor, round(avg(CAST(net_pnl_base > 0 AS DOUBLE)), 6) AS win_rate, round(avg(net_pnl_base) FILTER (net_pnl_base > 0) / abs(avg(net_pnl_base) FILTER (net_pnl_base < 0)), 6) AS payoff, round(avg(net_pnl_base), 9) AS expectancy, round(avg(net_pnl_base) * {NOTIONAL}, 6) AS expectancy_usd, round(avg(hold_bars), 6) AS avg_bars FROM trades GROUP BY ALL")
def m7(spark, folder):
    out = M.trade_metrics(X.trades(spark, folder), KEYS, "net_pnl_base", NOTIONAL)
    digits = {"profit_factor": 6, "win_rate": 6, "payoff": 6, "expectancy": 9, "expectancy_usd": 6, "avg_bars": 6}
    return out.select(*KEYS, "n_trades", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("M8_fold_metrics", SQL_TRADES, sql=f"SELECT fold_id, CAST(count(*) AS BIGINT) AS n, round(sum(gross_pnl), 6) AS total, round(avg(CAST(gross_pnl > 0 AS DOUBLE)), 6) AS win_rate, round({PF.format('gross_pnl')}, 6) AS profit_factor, round(sum(gross_pnl), 6) > 0 AS positive, round(avg(CAST(round(sum(gross_pnl), 6) > 0 AS DOUBLE)) OVER (), 6) AS pass_rate FROM trades GROUP BY fold_id")
def m8(spark, folder):
    out = M.fold_metrics(X.trades(spark, folder), "gross_pnl")
    return out.select("fold_id", "n", F.round("total", 6).alias("total"), F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 6).alias("profit_factor"), "positive", F.round("pass_rate", 6).alias("pass_rate"))


MULTIPLES = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
COSTS = SQL_TRADES + f""",
mt AS (SELECT trades.*, m AS multiple, gross_pnl - 0.0004 * m AS net FROM trades, (SELECT unnest([1.0::DOUBLE, 1.5, 2.0, 2.5, 3.0, 4.0]) AS m)),
mp AS (SELECT multiple, CAST(exit_time AS DATE) AS d, sum(net * {NOTIONAL}) AS pnl FROM mt GROUP BY ALL),
mc AS (SELECT multiple, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM mp GROUP BY multiple),
me AS (SELECT multiple, d, round(coalesce(pnl, 0), 6) AS pnl, round({CAPITAL} + sum(coalesce(pnl, 0)) OVER (PARTITION BY multiple ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS equity FROM mc LEFT JOIN mp USING (multiple, d)),
mr AS (SELECT *, CASE WHEN round(equity - pnl, 6) > 0 THEN pnl / round(equity - pnl, 6) ELSE 0 END AS ret, greatest({CAPITAL}, max(equity) OVER (PARTITION BY multiple ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM me)"""  # fmt: skip


@query("M9_cost_sensitivity", COSTS, sql=f"""SELECT multiple, round(sharpe, 6) AS sharpe, round(tr, 6) AS total_return_pct, round(mdd, 6) AS mdd_pct, round(wr, 6) AS win_rate, round(pf, 6) AS profit_factor, round(be, 6) AS breakeven, sharpe > 0 AND tr > 0 AND mdd > -25 AS investable FROM
(SELECT multiple, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(365) AS sharpe, (last(equity ORDER BY d) / {CAPITAL} - 1) * 100 AS tr, least(0, min((equity - peak) / peak)) * 100 AS mdd FROM mr GROUP BY multiple)
JOIN (SELECT multiple, avg(CAST(net > 0 AS DOUBLE)) AS wr, {PF.format('net')} AS pf, sum(gross_pnl) / (count(*) * 0.0004) AS be FROM mt GROUP BY multiple) USING (multiple)""")  # fmt: skip
def m9(spark, folder):
    out = M.cost_sensitivity(X.trades(spark, folder), MULTIPLES, 0.0004, NOTIONAL, CAPITAL)
    return out.select("multiple", *[F.round(c, 6).alias(c) for c in ("sharpe", "total_return_pct", "mdd_pct", "win_rate", "profit_factor", "breakeven")], "investable")


@query("M9_rules_by_cost", COSTS, _replay_sql("multiple, ", "mt", "net * 20000"), sql="SELECT multiple, CAST(taken AS BIGINT) AS taken, round(final_pnl, 4) AS final_pnl, violated_total, target_reached FROM r7 JOIN r8 USING (multiple)")
def m9_rules(spark, folder):
    money = {m: (F.col("gross_pnl") - F.lit(0.0004) * F.lit(m)) * 20000 for m in MULTIPLES}
    return _replayed(by_entry_day(spark, folder, []), [], money, "multiple").select("multiple", "taken", "final_pnl", "violated_total", "target_reached")


HAC = DAILY + """,
hu AS (SELECT symbol, side, d, ret, ret - avg(ret) OVER (PARTITION BY symbol, side) AS u, row_number() OVER (PARTITION BY symbol, side ORDER BY d) AS i, greatest(1, floor(4 * pow(count(*) OVER (PARTITION BY symbol, side) / 100.0::DOUBLE, 2.0::DOUBLE / 9))) AS L FROM dr),
hg AS (SELECT a.symbol, a.side, b.i - a.i AS k, any_value(a.L) AS L, sum(a.u * b.u) AS g FROM hu a JOIN hu b ON a.symbol = b.symbol AND a.side = b.side AND b.i >= a.i AND b.i <= a.i + a.L GROUP BY ALL)"""  # fmt: skip


@query("M10_hac_t", HAC, sql="SELECT symbol, side, CAST(n AS BIGINT) AS n_obs, CAST(L AS BIGINT) AS max_lags, round(CASE WHEN n >= 5 THEN m / nullif(sqrt(greatest(v, 0)) / n, 0) END, 6) AS t_stat FROM (SELECT symbol, side, count(*) AS n, avg(ret) AS m FROM hu GROUP BY ALL) JOIN (SELECT symbol, side, any_value(L) AS L, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (L + 1)) * g END) AS v FROM hg GROUP BY ALL) USING (symbol, side)")
def m10(spark, folder):
    return S.hac_t(daily(spark, folder), KEYS).select(*KEYS, "n_obs", F.col("max_lags").cast("long").alias("max_lags"), F.round("t_stat", 6).alias("t_stat"))


@query("M10_hac_test")
def m10_test(spark, folder):
    return S.hac_test(daily(spark, folder), KEYS)


@query("M11_slope", DAILY, sql="SELECT symbol, side, CAST(n AS BIGINT) AS n, round(slope * 1e9, 4) AS slope_e9, round(coalesce(slope / nullif(sqrt(greatest(0, syy - sxy * sxy / nullif(sxx, 0)) / greatest(n - 2, 1) / greatest(sxx, 1e-12)), 0), 0), 4) AS t_stat FROM (SELECT symbol, side, regr_count(m, i) AS n, regr_slope(m, i) AS slope, regr_sxx(m, i) AS sxx, regr_syy(m, i) AS syy, regr_sxy(m, i) AS sxy FROM (SELECT symbol, side, row_number() OVER (PARTITION BY symbol, side ORDER BY d) AS i, CASE WHEN count(ret) OVER w = 30 THEN avg(ret) OVER w END AS m FROM dr WINDOW w AS (PARTITION BY symbol, side ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) GROUP BY ALL)")
def m11(spark, folder):
    from pyspark.sql import Window

    rows = M.rolling_mean(daily(spark, folder), KEYS, (30,)).withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("day")))
    out = S.slope(rows, KEYS, "mean_30", "i")
    return out.select(*KEYS, "n", F.round(F.col("slope") * 1e9, 4).alias("slope_e9"), F.round("t_stat", 4).alias("t_stat"))


@query("M12_overfit_share", SQL_TRADES, sql="SELECT CAST(count(*) AS BIGINT) AS n_folds, CAST(count(*) FILTER (best > mid AND total < 0) AS BIGINT) AS n_over, count(*) FILTER (best > mid AND total < 0) / count(*) AS pbo, CASE WHEN count(*) FILTER (best > mid AND total < 0) / count(*) < 0.5 THEN 'PASS' WHEN count(*) FILTER (best > mid AND total < 0) / count(*) < 0.75 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM (SELECT fold_id, max(score) AS best, median(score) AS mid FROM (SELECT fold_id, symbol, side, round(sum(gross_pnl), 6) AS score FROM trades WHERE segment = 'IS' GROUP BY ALL) GROUP BY fold_id) JOIN (SELECT fold_id, sum(net_pnl_base) AS total FROM trades WHERE segment = 'OOS' GROUP BY fold_id) USING (fold_id)")
def m12(spark, folder):
    t = X.trades(spark, folder)
    tuning = t.where("segment = 'IS'").groupBy("fold_id", "symbol", "side").agg(F.round(F.sum("gross_pnl"), 6).alias("score"))
    return S.overfit_share(tuning, t.where("segment = 'OOS'"))


@query("M13_deflated_sharpe")
def m13(spark, folder):
    return S.deflated_sharpe(daily(spark, folder), KEYS, 18)


@query("M14_t_test")
def m14(spark, folder):
    return S.t_test(X.trades(spark, folder).where("segment = 'OOS'"), ["symbol", "side", "fold_id"], "gross_pnl")


@query("M15_benjamini_hochberg", SQL_TRADES, sql="SELECT symbol, side, fold_id, p, coalesce(k <= max(CASE WHEN p <= k * 0.5 / n THEN k END) OVER (), false) AS reject FROM (SELECT *, row_number() OVER (ORDER BY p, symbol, side, fold_id) AS k, count(*) OVER () AS n FROM (SELECT symbol, side, fold_id, round(avg(CAST(gross_pnl <= 0 AS DOUBLE)), 9) AS p FROM trades GROUP BY ALL))")
def m15(spark, folder):
    rows = X.trades(spark, folder).groupBy("symbol", "side", "fold_id").agg(F.round(F.avg((F.col("gross_pnl") <= 0).cast("double")), 9).alias("p"))
    return S.benjamini_hochberg(rows, "p", 0.5, ["symbol", "side", "fold_id"])


LONGM = "lm AS (SELECT symbol, metric, value FROM (SELECT symbol, unnest(['n_trades', 'profit_factor', 'win_rate', 'ulcer_index', 'other']) AS metric, unnest([CAST(count(*) AS DOUBLE), round(" + PF.format("net_pnl_base") + ", 6), round(avg(CAST(net_pnl_base > 0 AS DOUBLE)), 6), 7.0, 1.0]) AS value FROM trades GROUP BY symbol)), vd AS (SELECT *, CASE metric WHEN 'n_trades' THEN CASE WHEN value >= 30 THEN 'PASS' WHEN value >= 15 THEN 'WARN' ELSE 'FAIL' END WHEN 'profit_factor' THEN CASE WHEN value >= 1.5 THEN 'PASS' WHEN value >= 1 THEN 'WARN' ELSE 'FAIL' END WHEN 'win_rate' THEN CASE WHEN value >= 0.4 THEN 'PASS' WHEN value >= 0.2 THEN 'WARN' ELSE 'FAIL' END WHEN 'ulcer_index' THEN CASE WHEN value <= 5 THEN 'PASS' WHEN value <= 10 THEN 'WARN' ELSE 'FAIL' END ELSE 'N/A' END AS verdict FROM lm)"


def judged(spark, folder) -> DataFrame:
    own = M.trade_metrics(X.trades(spark, folder), ["symbol"], "net_pnl_base")
    pair = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    metrics = F.array(pair("n_trades", F.col("n_trades")), pair("profit_factor", F.round("profit_factor", 6)), pair("win_rate", F.round("win_rate", 6)), pair("ulcer_index", F.lit(7.0)), pair("other", F.lit(1.0)))
    return M.verdicts(own.select("symbol", F.explode(metrics).alias("m")).select("symbol", "m.metric", "m.value"))


@query("F18_verdicts", SQL_TRADES, LONGM, sql="SELECT symbol, metric, value, verdict FROM vd")
def f18(spark, folder):
    return judged(spark, folder).select("symbol", "metric", "value", "verdict")


@query("M16_overall_verdict", SQL_TRADES, LONGM, sql="SELECT CAST(count(*) FILTER (verdict = 'PASS') AS BIGINT) AS n_pass, CAST(count(*) FILTER (verdict = 'WARN') AS BIGINT) AS n_warn, CAST(count(*) FILTER (verdict = 'FAIL') AS BIGINT) AS n_fail, CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM vd")
def m16(spark, folder):
    return M.overall(judged(spark, folder))


# Resampling of all symbols, segments and folds; DuckDB draws the same numbers.
REPS, RISK_REPS, SEED, BLOCK = 1000, 10_000, 42, 5
SERIES_KEYS = ["symbol", "segment", "fold_id"]


def _bits(i: str, seed: int = SEED) -> str:
    """The draw's 52 bits for a replicate rep."""
    return f"('0x' || left(md5('{seed}:' || rep || ':' || {i}), 13))::BIGINT"


def _draw(i: str, n: str, seed: int = SEED) -> str:
    return f"{_bits(i, seed)} % {n}"


SERIES = SQL_TRADES + f""",
ser AS (SELECT dense_rank() OVER (ORDER BY symbol, segment, fold_id) AS g, symbol, segment, fold_id, row_number() OVER (PARTITION BY symbol, segment, fold_id ORDER BY {ORDER}) - 1 AS pos, net_pnl_base / 10 AS v FROM trades),
grp AS (SELECT g, symbol, segment, fold_id, count(*) AS n FROM ser GROUP BY ALL),
slot AS (SELECT g, n, rep, unnest(generate_series(0, n - 1)) AS i FROM (SELECT g, n, unnest(generate_series(0, {REPS - 1})) AS rep FROM grp))"""  # fmt: skip
PATHS = "pth AS (SELECT g, rep, last(e ORDER BY i) AS final, least(0, min(e / p - 1)) AS mdd FROM (SELECT *, greatest(1, max(e) OVER (PARTITION BY g, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p FROM (SELECT *, exp(sum(ln(1 + v)) OVER (PARTITION BY g, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS e FROM drw)) GROUP BY g, rep)"


def _drawn(src: str) -> str:
    return f"drw AS (SELECT s.g, rep, i, v FROM (SELECT *, {src} AS src FROM slot) s JOIN ser ON ser.g = s.g AND ser.pos = s.src)"


def series(spark, folder) -> DataFrame:
    return R.numbered(scaled(spark, folder), SERIES_KEYS, TRADE_ORDER, "r")


def _paths(spark, folder, draw: R.Draw, *fields: str) -> DataFrame:
    return R.resampled_paths(series(spark, folder), SERIES_KEYS, REPS, {"own": draw}, SEED, fields or ("final", "mdd"))


def _quantiles(paths: DataFrame) -> DataFrame:
    out = R.path_quantiles(paths, SERIES_KEYS)
    return out.select(*SERIES_KEYS, "metric", *[F.round(c, 6).alias(c) for c in ("p5", "p25", "p50", "p75", "p95")])


FLOOR = ", ".join(f"round(list_sort(list({{0}}))[least(CAST(floor(count(*) * {q}::DOUBLE) AS INT), count(*) - 1) + 1], 6) AS p{p}" for p, q in ((5, 0.05), (25, 0.25), (50, 0.5), (75, 0.75), (95, 0.95)))
QUANTILES = f"SELECT symbol, segment, fold_id, metric, p5, p25, p50, p75, p95 FROM (SELECT g, 'final' AS metric, {FLOOR.format('final')} FROM pth GROUP BY g UNION ALL SELECT g, 'mdd', {FLOOR.format('mdd')} FROM pth GROUP BY g) JOIN grp USING (g)"


@query("B1_bootstrap_mean", SERIES, _drawn(_draw("i", "n")), sql="SELECT symbol, segment, fold_id, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, round(avg(m), 9) AS mean FROM (SELECT g, rep, avg(v) AS m FROM drw GROUP BY ALL) JOIN grp USING (g) GROUP BY symbol, segment, fold_id")
def b1(spark, folder):
    out = R.mean_interval(_paths(spark, folder, R.Draw("iid"), "mean"), SERIES_KEYS)
    return out.select(*SERIES_KEYS, *[F.round(c, 9).alias(c) for c in ("low", "high", "mean")])


@query("B2_iid_paths", SERIES, _drawn(_draw("i", "n")), PATHS, sql=QUANTILES)
def b2(spark, folder):
    return _quantiles(_paths(spark, folder, R.Draw("iid")))


@query("B3_circular_blocks", SERIES, _drawn(f"({_draw(f'(i // {BLOCK})', 'n')} + i % {BLOCK}) % n"), PATHS, sql=QUANTILES)
def b3(spark, folder):
    return _quantiles(_paths(spark, folder, R.Draw("circular", BLOCK)))


STRESSED = f"drw AS (SELECT g, rep, i, v - avg(abs(v)) OVER (PARTITION BY g) * 0.5 - CASE WHEN {_bits('i', SEED + 2)} / 4503599627370496::DOUBLE < 0.1::DOUBLE THEN 0.001 ELSE 0 END AS v FROM dr0)"


@query("B4_stressed_paths", SERIES, _drawn(_draw("i", "n")).replace("drw AS", "dr0 AS", 1), STRESSED, PATHS, sql=QUANTILES)
def b4(spark, folder):
    return _quantiles(_paths(spark, folder, R.STRESSED))


ACCOUNT = SQL_TRADES + f""",
dv AS (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY d) - 1 AS pos, count(*) OVER (PARTITION BY segment) AS n, d, pnl AS v FROM (SELECT segment, CAST(exit_time AS DATE) AS d, round(sum(gross_pnl) * 1000, 6) AS pnl FROM trades GROUP BY ALL)),
ds AS (SELECT segment, n, rep, unnest(generate_series(0, n - 1)) AS i FROM (SELECT segment, max(n) AS n, unnest(generate_series(0, {REPS - 1})) AS rep FROM dv GROUP BY segment)),
da AS (SELECT s.segment, rep, i, v AS pnl, t.d FROM (SELECT *, least({_draw(f'(i // {BLOCK})', f'greatest(n - {BLOCK} + 1, 1)')} + i % {BLOCK}, n - 1) AS src FROM ds) s JOIN dv x ON x.segment = s.segment AND x.pos = s.src JOIN (SELECT segment, pos AS tp, d FROM dv) t ON t.segment = s.segment AND t.tp = s.i),
dw AS (SELECT *, round(sum(pnl) OVER w, 6) AS eq, count(*) OVER w AS days FROM da WINDOW w AS (PARTITION BY segment, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dx AS (SELECT *, CASE WHEN eq <= -{RULES['total_loss']} THEN 1 WHEN eq >= {RULES['target']} AND days >= 2 THEN 2 ELSE 0 END AS st FROM dw),
dy AS (SELECT *, coalesce(max(st) OVER (PARTITION BY segment, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dx),
dz AS (SELECT segment, rep, max(CAST(st = 1 AS INT)) AS bust, max(CAST(st = 2 AS INT)) AS won, max(CAST(pnl <= -{RULES['daily_loss']} AS INT)) AS vd, sum(pnl) AS final FROM dy WHERE before = 0 GROUP BY segment, rep)"""  # fmt: skip


@query("B5_resampled_rules", ACCOUNT, sql="SELECT segment, CAST(count(*) AS BIGINT) AS replicates, avg(bust) AS total_rate, avg(won) AS target_rate, avg(CAST(won = 1 AND vd = 0 AS DOUBLE)) AS pass_rate, round(quantile_cont(final, 0.5), 4) AS median_pnl FROM dz GROUP BY segment")
def b5(spark, folder):
    """Days of each segment resampled in blocks, dates kept in order, the rules replayed for every replicate."""
    key = ["segment"]
    days = M.daily_pnl(X.trades(spark, folder), key, F.col("gross_pnl")).withColumn("pnl", F.round(F.col("pnl") * 1000, 6))
    out = R.resampled_rules(R.numbered(days, key, ["day"], "pnl"), key, REPS, R.Draw("plain", BLOCK), SEED, RULES["daily_loss"], RULES["total_loss"], RULES["target"], RULES["min_days"])
    passed = (F.col("target_reached") == 1) & (F.col("violated_daily") == 0)
    return out.groupBy(*key).agg(F.count(F.lit(1)).alias("replicates"), F.avg("violated_total").alias("total_rate"), F.avg("target_reached").alias("target_rate"), F.avg(passed.cast("double")).alias("pass_rate"), F.round(F.percentile("final_pnl", F.lit(0.5)), 4).alias("median_pnl"))


@query("B6_stationary_bootstrap")
def b6(spark, folder):
    rows = R.numbered(daily(spark, folder), KEYS, ["day"], "ret")
    return R.series_risk(R.resampled_paths(rows, KEYS, RISK_REPS, {"own": R.Draw("stationary")}, SEED), KEYS)


@query("B7_all_methods")
def b7(spark, folder):
    return R.all_methods(series(spark, folder), SERIES_KEYS, REPS, BLOCK, SEED)



"""Queries over scalar functions, costs, features, folds and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import costs as C
from barloom.functions import ranks as R
from barloom.functions import times as D
from barloom.operators import features as W
from barloom.operators import folds as O
from barloom.operators import gates as G
from barloom.plans.bar_queries import DAY, EP, day, ep
from barloom.plans.registry import query
from barloom.sources import fixtures as X
from barloom.sources.fixtures import LONG, SHORT, SQL_BARS, SQL_FOLDS, SQL_QUOTES, SQL_TRADES

CLASSES = {"EQUITY": 2.0, "ENERGY": 3.0, "METAL": 4.0}
# Names of instruments put in place of the parts' own, so that every class occurs.
NAMES = (
    "EURUSD", "EURSEK", "XAUUSD", "USOIL", "BTCUSD", "US500.CASH", "ACME", "GER40", "AVAXUSD", "PEPEUSD", "XLMUSD", "UNIUSD", "LINKUSD", "OPUSD", "TONUSD", "SEKUSD", "USDJPY", "GBPCHF", "NZDCAD", "XPTEUR", "NATGAS",
    "BRENT.SPOT", "UK100", "JP225", "FRA40", "ZARJPY", "NOKEUR", "EURPLN", "btcusdt", "SPX500", "SHIBUSD", "ICPUSD",
)


def named_quotes(spark, folder) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    key = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    return X.quotes(spark, folder).withColumn("key", key).withColumn("name", F.element_at(names, F.col("key") % len(NAMES) + 1)).withColumn("asset_class", C.asset_class(F.col("name"), F.concat(F.when(F.col("name") == "ACME", F.lit("Stocks/")).otherwise(F.lit("")), F.col("path")), F.col("description")))


MAJOR = ", ".join(f"'{x}'" for x in C.MAJORS)
FX = f"length(s) BETWEEN 6 AND 10 AND right(s, 3) IN ({MAJOR})"
SQL_NAMED = SQL_QUOTES + f""",
named AS (SELECT * EXCLUDE (s, p, d),
    CASE WHEN regexp_matches(s, '{C.INDEX_PATTERN}') OR regexp_matches(p, '{C.INDEX_PATTERN}') THEN 'INDEX' WHEN regexp_matches(s, '{C.METAL_PATTERN}') THEN 'METAL'
      WHEN regexp_matches(s, '{C.ENERGY_PATTERN}') OR regexp_matches(p, '{C.ENERGY_PATTERN}') THEN 'ENERGY' WHEN contains(p, 'CRYPTO') OR contains(d, 'CRYPTO') OR regexp_matches(s, '^({"|".join(C.CRYPTO_PREFIXES)})') THEN 'CRYPTO'
      WHEN {FX} AND left(s, 3) IN ({MAJOR}) THEN 'FX_MAJOR' WHEN {FX} THEN 'FX_MINOR' WHEN regexp_matches(p, '{C.EQUITY_PATTERN}') OR regexp_matches(d, '{C.EQUITY_PATTERN}') THEN 'EQUITY' ELSE 'OTHER' END AS asset_class
  FROM (SELECT *, upper(name) AS s, upper(CASE WHEN name = 'ACME' THEN 'Stocks/' ELSE '' END || path) AS p, upper(description) AS d
    FROM (SELECT *, {list(NAMES)}[key % {len(NAMES)} + 1] AS name FROM (SELECT *, CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INT) AS key FROM quotes))))"""  # fmt: skip


def _by_name(crypto: tuple[str, ...]) -> str:
    has = lambda names: f"regexp_matches(upper(name), '{'|'.join(names)}')"
    money = "|".join(C.CURRENCIES)
    return f"CASE WHEN {has(crypto)} THEN 'crypto' WHEN {has(C.METAL_NAMES)} THEN 'metal' WHEN {has(C.ENERGY_NAMES)} THEN 'energy' WHEN {has(C.INDEX_NAMES)} THEN 'index' WHEN regexp_matches(upper(name), '^({money})|({money})$') THEN 'forex' ELSE 'other' END"


@query("F1_asset_class", SQL_NAMED, sql="SELECT symbol, name, coalesce(asset_class, 'OTHER') AS asset_class FROM named")
def f1(spark, folder):
    return named_quotes(spark, folder).select("symbol", "name", "asset_class")


@query("F2_asset_class_by_name", SQL_NAMED, sql=f"SELECT symbol, {_by_name(C.CRYPTO_NAMES)} AS by_name, {_by_name(C.MORE_CRYPTO_NAMES)} AS by_more_names FROM named")
def f2(spark, folder):
    return named_quotes(spark, folder).select("symbol", C.asset_class_by_name(F.col("name")).alias("by_name"), C.asset_class_by_name(F.col("name"), C.MORE_CRYPTO_NAMES).alias("by_more_names"))


def priced(spark, folder) -> DataFrame:
    overrides = spark.sql("SELECT 'BRAND#1-20' AS symbol, 1.5D AS value_usd, false AS round_trip")
    classes = spark.sql("SELECT 'EQUITY' AS asset_class, 2.0D AS value_usd, true AS round_trip UNION ALL SELECT 'METAL', 3.0D, false UNION ALL SELECT 'INDEX', 0.0D, true")
    return C.commission(named_quotes(spark, folder), overrides, classes, 1.0)


SQL_PRICED = SQL_NAMED + """,
priced AS (SELECT *, CASE WHEN symbol = 'BRAND#1-20' THEN 3.0 WHEN asset_class = 'EQUITY' THEN 2.0 WHEN asset_class = 'METAL' THEN 6.0 WHEN asset_class = 'INDEX' THEN 0.0 ELSE 1.0 END::DOUBLE AS commission_usd FROM named),
cost0 AS (SELECT *, (bid + ask) * 0.5 AS mid FROM priced),
cost1 AS (SELECT *, CASE WHEN ask > bid THEN (ask - bid) / mid * 10000 END AS spread_bps, CASE WHEN contract_size > 0 THEN commission_usd / (mid * contract_size) * 10000 WHEN commission_usd = 0 THEN 0.0 END AS commission_bps FROM cost0),
cost2 AS (SELECT *, coalesce(spread_bps, 0) + coalesce(commission_bps, 0) + 1.0 AS cost_bps, CASE WHEN asset_class = 'EQUITY' THEN 4.0 WHEN asset_class = 'METAL' THEN 6.0 WHEN asset_class IN ('INDEX', 'ENERGY') THEN 3.0 END::DOUBLE AS threshold_bps FROM cost1)"""  # fmt: skip


@query("F6_commission_lookup", SQL_PRICED, sql="SELECT symbol, commission_usd FROM priced")
def f6(spark, folder):
    return priced(spark, folder).select("symbol", "commission_usd")


@query("D1_commission_without_udf", SQL_PRICED, sql="SELECT coalesce(asset_class, 'OTHER') AS asset_class, CAST(count(*) AS BIGINT) AS n, sum(commission_usd) AS usd FROM priced GROUP BY 1")
def d1(spark, folder):
    return priced(spark, folder).groupBy("asset_class").agg(F.count(F.lit(1)).alias("n"), F.sum("commission_usd").alias("usd"))


@query("D2_relative_paths", SQL_QUOTES, sql="SELECT symbol, CASE WHEN contract_size > 10 THEN 'gold/' || symbol ELSE 'other/' || symbol END AS path FROM quotes")
def d2(spark, folder):
    path = F.when(F.col("contract_size") > 10, F.concat(F.lit("/data/store/gold/"), "symbol")).otherwise(F.concat(F.lit("other/"), "symbol"))
    return X.quotes(spark, folder).select("symbol", D.relative_path(path, F.lit("/data/store")).alias("path"))


@query("F3_cost_bps", SQL_PRICED, sql="SELECT symbol, mid, spread_bps, commission_bps, cost_bps FROM cost2")
def f3(spark, folder):
    return C.quote_costs(priced(spark, folder), 1.0).select("symbol", "mid", "spread_bps", "commission_bps", "cost_bps")


def thresholds(spark, folder) -> DataFrame:
    limits = spark.sql("SELECT 'EQUITY' AS asset_class, 4.0D AS threshold_bps UNION ALL SELECT 'METAL', 6.0D UNION ALL SELECT 'INDEX', 3.0D UNION ALL SELECT 'ENERGY', 3.0D")
    return C.eligibility(C.quote_costs(priced(spark, folder), 1.0).join(F.broadcast(limits), "asset_class", "left"))


@query("J1_lookup_join", SQL_PRICED, sql="SELECT symbol, coalesce(asset_class, 'OTHER') AS asset_class, threshold_bps FROM cost2")
def j1(spark, folder):
    return thresholds(spark, folder).select("symbol", "asset_class", "threshold_bps")


@query("P12_eligibility", SQL_PRICED, sql="SELECT symbol, coalesce(cost_bps <= threshold_bps, false) AND visible AND trade_mode >= 0 AS eligible FROM cost2")
def p12(spark, folder):
    return thresholds(spark, folder).select("symbol", "eligible")


@query("F4_reason_string", SQL_PRICED, sql="SELECT symbol, concat_ws(';', CASE WHEN spread_bps IS NULL THEN 'SPREAD_BPS_MISSING' END, CASE WHEN commission_bps IS NULL THEN 'COMMISSION_BPS_MISSING' END, CASE WHEN cost_bps > threshold_bps THEN 'COST>' || CAST(threshold_bps AS VARCHAR) || 'bps' END, CASE WHEN NOT visible THEN 'NOT_VISIBLE' END, CASE WHEN trade_mode < 0 THEN 'TRADE_MODE<0' END) AS reason FROM cost2")
def f4(spark, folder):
    return thresholds(spark, folder).select("symbol", "reason")


@query("F5_cost_flag", SQL_PRICED, sql="SELECT symbol, CASE WHEN threshold_bps IS NULL THEN 'UNKNOWN' WHEN cost_bps <= threshold_bps * 0.5 THEN 'OK' WHEN cost_bps <= threshold_bps THEN 'CARO' ELSE 'PROHIBITIVO' END AS cost_flag FROM cost2")
def f5(spark, folder):
    return thresholds(spark, folder).select("symbol", "cost_flag")


@query("A34_typical_commission", SQL_PRICED, sql="SELECT symbol, CASE WHEN commission_bps > 0 THEN commission_bps ELSE coalesce(median(commission_bps) FILTER (commission_bps > 0) OVER (PARTITION BY coalesce(asset_class, 'OTHER')), CASE WHEN asset_class = 'INDEX' THEN 0.25 END, 0.5) END AS commission_eff_bps FROM cost2")
def a34(spark, folder):
    return C.typical_commission(C.quote_costs(priced(spark, folder), 1.0), {"INDEX": 0.25}).select("symbol", "commission_eff_bps")


@query("F7_spread_bps", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, spread / close * 10000 AS spread_bps FROM bars")
def f7(spark, folder):
    return X.bars(spark, folder).select("symbol", ep("time_utc").alias("t"), C.spread_in_bps(F.col("spread"), F.col("close")).alias("spread_bps"))


@query("F8_round_trip_cost", SQL_PRICED, sql="SELECT symbol, 2 * (spread_bps / 2 + commission_bps + 1.0) / 10000 AS base, 2 * (spread_bps * 2 / 2 + commission_bps * 2 + 3.0) / 10000 AS stress FROM cost1 WHERE spread_bps IS NOT NULL")
def f8(spark, folder):
    rows = C.quote_costs(priced(spark, folder), 1.0).where("spread_bps is not null")
    parts = [F.col(c) for c in ("spread_bps", "commission_bps", "slippage_bps")]
    return rows.select("symbol", C.round_trip(*parts).alias("base"), C.stressed(*parts).alias("stress"))


@query("F9_fill_price", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, open * (1 + 1 * (1.0 + 3.0 / 2) / 10000) AS buy, open * (1 + -1 * (1.0 + 3.0 / 2) / 10000) AS sell FROM bars")
def f9(spark, folder):
    at = lambda s: C.fill_price(F.col("open"), F.lit(s), F.lit(3.0), F.lit(1.0))
    return X.bars(spark, folder).select("symbol", ep("time_utc").alias("t"), at(1).alias("buy"), at(-1).alias("sell"))


MICRO = SQL_BARS + """,
mic0 AS (SELECT symbol, spread / close * 10000 AS s, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY time_utc) - 1) * 10000 AS r FROM bars),
mic AS (SELECT symbol, count(*) AS n_rows, count(s) AS n_spread, median(s) AS spread_med, median(r) AS vol_med, list_sort(list(s))[CAST(round((count(s) - 1) * 0.95::DOUBLE) AS INT) + 1] AS spread_p95, list_sort(list(r) FILTER (r IS NOT NULL))[CAST(round((count(r) - 1) * 0.95::DOUBLE) AS INT) + 1] AS vol_p95 FROM mic0 GROUP BY symbol)"""  # fmt: skip


@query("A20_micro_structure", MICRO, sql="SELECT * FROM mic")
def a20(spark, folder):
    return C.micro_structure(X.bars(spark, folder))


@query("F10_cost_model", MICRO, sql="SELECT symbol, CASE WHEN symbol = 'CLICK' THEN 'equity' WHEN symbol = 'VIEW' THEN 'fx_metal' ELSE 'other' END AS asset_class, CASE WHEN symbol = 'ERROR' THEN 'volatility' ELSE 'spread' END AS slippage_method, 3.0 + CASE WHEN symbol = 'ERROR' THEN vol_med * 0.10 ELSE spread_med * 0.50 END + CASE WHEN symbol = 'CLICK' THEN 2.0 WHEN symbol = 'VIEW' THEN 1.0 ELSE 0.0 END AS total_base, 6.0 + CASE WHEN symbol = 'ERROR' THEN vol_p95 * 0.15 ELSE spread_p95 * 0.75 END + CASE WHEN symbol = 'CLICK' THEN 6.0 WHEN symbol = 'VIEW' THEN 3.0 ELSE 0.0 END AS total_stress FROM mic")
def f10(spark, folder):
    rows = C.micro_structure(X.bars(spark, folder)).withColumns({
        "asset_class": F.when(F.col("symbol") == "CLICK", "equity").when(F.col("symbol") == "VIEW", "fx_metal").otherwise("other"), "base_cost_bps": F.lit(3.0), "stress_cost_bps": F.lit(6.0),
        "n_spread": F.when(F.col("symbol") == "ERROR", 0).otherwise(F.col("n_spread")),
    })
    return C.cost_model(rows).select("symbol", "asset_class", "slippage_method", "total_base", "total_stress")


@query("F12_zone_dates", sql="SELECT event_id, strftime(CAST(timezone('Europe/Paris', timezone('UTC', ts)) AS DATE), '%Y-%m-%d') AS paris_date, strftime(CAST(ts + INTERVAL 2 HOUR AS DATE), '%Y-%m-%d') AS offset_date FROM events")
def f12(spark, folder):
    e = X.table(spark, folder, "events")
    return e.select("event_id", D.trading_date(F.col("ts")).cast("string").alias("paris_date"), D.offset_date(F.col("ts"), 2).cast("string").alias("offset_date"))


@query("F13_day_codes", sql="SELECT event_id, strftime(ts, '%Y%m%d') AS code, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS parsed FROM events")
def f13(spark, folder):
    code = D.day_code(F.col("ts"))
    return X.table(spark, folder, "events").select("event_id", code.alias("code"), D.parse_day(F.concat(F.lit("x=7/part="), F.substring(code, 1, 4), F.lit("-"), F.substring(code, 5, 4))).cast("string").alias("parsed"))


@query("F14_truncation", sql="SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS d, isodow(o_orderdate)::INT AS dow, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS INT) AS months FROM orders")
def f14(spark, folder):
    t = F.col("o_orderdate")
    return X.table(spark, folder, "orders").select("o_orderkey", F.unix_timestamp(F.date_trunc("day", t)).alias("d"), D.iso_weekday(t).alias("dow"), ((F.year(t) - 1992) * 12 + F.month(t)).alias("months"))


@query("F15_symbol_names", sql="SELECT event_id, upper(event_type) AS symbol FROM events")
def f15(spark, folder):
    return X.table(spark, folder, "events").select("event_id", D.symbol_name(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("symbol"))


@query("F19_session_windows", SQL_QUOTES, sql="SELECT symbol, CAST(2 AS INT) AS n, '08:00' AS first_start, '21:00' AS last_end FROM quotes")
def f19(spark, folder):
    text = F.to_json(F.array(F.struct(F.lit("08:00").alias("start"), F.lit("12:00").alias("end")), F.struct(F.lit("13:30").alias("start"), F.lit("21:00").alias("end"))))
    rows = X.quotes(spark, folder).withColumn("session_windows", text).withColumn("w", D.session_windows(F.col("session_windows")))
    return rows.select("symbol", F.size("w").alias("n"), F.col("w")[0]["start"].alias("first_start"), F.element_at("w", -1)["end"].alias("last_end"))


@query("A13_nearest_rank", SQL_TRADES, sql="SELECT symbol, side, list_sort(list(net_pnl_base))[CAST(round((count(*) - 1) * 0.5::DOUBLE) AS INT) + 1] AS p50, list_sort(list(net_pnl_base))[CAST(round((count(*) - 1) * 0.9::DOUBLE) AS INT) + 1] AS p90, list_sort(list(net_pnl_base))[CAST(round((count(*) - 1) * 0.99::DOUBLE) AS INT) + 1] AS p99 FROM trades GROUP BY ALL")
def a13(spark, folder):
    return R.nearest_rank(X.trades(spark, folder), ["symbol", "side"], "net_pnl_base", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("A14_linear_quantiles", SQL_BARS, sql="SELECT symbol, round(quantile_cont(close, 0.333), 6) AS a, round(quantile_cont(close, 0.667), 6) AS b FROM bars GROUP BY symbol")
def a14(spark, folder):
    return X.bars(spark, folder).groupBy("symbol").agg(F.round(R.linear("close", 0.333), 6).alias("a"), F.round(R.linear("close", 0.667), 6).alias("b"))


@query("A15_floor_rank", SQL_BARS, sql="SELECT symbol, list_sort(list(close))[least(CAST(floor(count(*) * 0.6::DOUBLE) AS INT), count(*) - 1) + 1] AS q60, list_sort(list(close))[least(CAST(floor(count(*) * 1.0::DOUBLE) AS INT), count(*) - 1) + 1] AS q100 FROM bars GROUP BY symbol")
def a15(spark, folder):
    return R.floor_rank(X.bars(spark, folder), ["symbol"], "close", {"q60": 0.6, "q100": 1.0})


@query("P6_weekday_filter", SQL_BARS, sql="SELECT symbol, CAST(count(*) FILTER (isodow(time_utc) <= 5) AS BIGINT) AS weekdays, CAST(count(*) FILTER (isodow(time_utc) >= 6) AS BIGINT) AS weekends FROM bars GROUP BY symbol")
def p6(spark, folder):
    return X.bars(spark, folder).groupBy("symbol").agg(F.count_if(D.iso_weekday(F.col("time_utc")) <= 5).alias("weekdays"), F.count_if(D.is_weekend(F.col("time_utc"))).alias("weekends"))


@query("P7_fold_ranges", SQL_BARS, SQL_FOLDS, sql="SELECT symbol, fold_id, CAST(count(*) FILTER (time_utc >= is_start AND time_utc < is_end) AS BIGINT) AS half_open, CAST(count(*) FILTER (time_utc >= is_start AND time_utc <= is_end) AS BIGINT) AS closed FROM bars JOIN folds USING (symbol) GROUP BY ALL")
def p7(spark, folder):
    return O.range_counts(X.bars(spark, folder), X.folds(spark, folder))


FEAT = SQL_BARS + f""",
f1 AS (SELECT *, lag(close) OVER w AS prev_close, lag(close, {LONG}) OVER w AS back, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time_utc)),
f2 AS (SELECT *, CASE WHEN prev_close > 0 THEN close / prev_close - 1 END AS ret, abs(close - prev_close) AS abs_diff, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr FROM f1),
f3 AS (SELECT *, CASE WHEN count(ret) OVER l = {LONG} THEN stddev_samp(ret) OVER l END * 10000 AS vol_bps, (close / back - 1) * 10000 AS mom_bps, abs(close - back) / (CASE WHEN count(abs_diff) OVER l = {LONG} THEN sum(abs_diff) OVER l END + 1e-12) AS er,
  CASE WHEN count(tr) OVER s = {SHORT} THEN avg(tr) OVER s END AS atr, CASE WHEN count(close) OVER s = {SHORT} THEN avg(close) OVER s END AS bb_mid, CASE WHEN count(close) OVER s = {SHORT} THEN stddev_samp(close) OVER s END AS bb_std,
  CASE WHEN count(high) OVER s = {SHORT} THEN max(high) OVER s - min(low) OVER s END AS span
  FROM f2 WINDOW l AS (PARTITION BY symbol ORDER BY time_utc ROWS BETWEEN {LONG - 1} PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY time_utc ROWS BETWEEN {SHORT - 1} PRECEDING AND CURRENT ROW)),
f4 AS (SELECT *, atr / close * 10000 AS atr_bps, abs(mom_bps) / (vol_bps + 1e-12) AS mom_eff, (close - (bb_mid - 2 * bb_std)) / ((bb_mid + 2 * bb_std) - (bb_mid - 2 * bb_std) + 1e-12) AS pct_b, (close - bb_mid) / greatest(atr, 1e-10) AS dist_mean_atr, span / greatest(atr, 1e-10) AS range_width_atr FROM f3),
feat AS (SELECT *, dist_mean_atr - lag(dist_mean_atr, 3) OVER (PARTITION BY symbol ORDER BY time_utc) AS dist_vel_3 FROM f4)"""  # fmt: skip


def features(spark, folder) -> DataFrame:
    return W.all_features(X.bars(spark, folder), LONG, SHORT)


def _feature(name: str, columns: list[str], function=None):
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, FEAT, sql=f"SELECT symbol, {EP} AS t, {rounded} FROM feat")
    def run(spark, folder):
        rows = features(spark, folder)
        return rows.select("symbol", ep("time_utc").alias("t"), *[F.round(c, 6).alias(c) for c in columns])


_feature("W1_returns", ["ret", "abs_diff"])
_feature("W2_volatility", ["vol_bps"])
_feature("W3_momentum", ["mom_bps"])
_feature("W4_efficiency_ratio", ["er"])
_feature("W5_average_true_range", ["tr", "atr", "atr_bps"])
_feature("W6_momentum_efficiency", ["mom_eff"])
_feature("W9_bollinger", ["bb_mid", "bb_std", "pct_b"])
_feature("W10_range_features", ["dist_mean_atr", "range_width_atr"])
_feature("W11_velocity", ["dist_vel_3"])

EMA = SQL_BARS.replace("ticks AS", "RECURSIVE ticks AS", 1) + """,
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time_utc) AS rn FROM bars),
ema AS (SELECT symbol, time_utc, rn, close AS fast, close AS slow, close AS top, CAST(1 AS DOUBLE) AS bottom FROM num WHERE rn = 1
  UNION ALL SELECT n.symbol, n.time_utc, n.rn, (1 - 2.0::DOUBLE / 9) * e.fast + (2.0::DOUBLE / 9) * n.close, (1 - 2.0::DOUBLE / 25) * e.slow + (2.0::DOUBLE / 25) * n.close, (1 - 2.0::DOUBLE / 9) * e.top + n.close, (1 - 2.0::DOUBLE / 9) * e.bottom + 1 FROM ema e JOIN num n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""  # fmt: skip


def averages(spark, folder) -> DataFrame:
    return W.ewm(W.ewm(X.bars(spark, folder), "close", 8, "fast"), "close", 24, "slow")


@query("W7_exponential_average", EMA, sql=f"SELECT symbol, {EP} AS t, round(fast, 6) AS fast, round(slow, 6) AS slow FROM ema")
def w7(spark, folder):
    return averages(spark, folder).select("symbol", ep("time_utc").alias("t"), F.round("fast", 6).alias("fast"), F.round("slow", 6).alias("slow"))


@query("W7_exponential_average_adjusted", EMA, sql=f"SELECT symbol, {EP} AS t, round(top / bottom, 6) AS fast FROM ema")
def w7_adjusted(spark, folder):
    return W.ewm(X.bars(spark, folder), "close", 8, "fast", adjust=True).select("symbol", ep("time_utc").alias("t"), F.round("fast", 6).alias("fast"))


@query("W8_trend", EMA, sql=f"SELECT symbol, {EP} AS t, CASE WHEN abs(fast - slow) < 1e-9 THEN 0 ELSE sign(fast - slow) END::DOUBLE AS trend_dir, round((fast - slow) / slow * 10000, 5) AS trend_bps, round((slow / lag(slow, 12) OVER (PARTITION BY symbol ORDER BY time_utc) - 1) * 10000, 5) AS slope_bps FROM ema WHERE rn > 1")
def w8(spark, folder):
    rows = W.trend(averages(spark, folder), "fast", "slow", 12).withColumn("rn", F.row_number().over(W.by_time())).where("rn > 1")
    rows = rows.withColumn("slope_bps", F.when(F.col("rn") > 13, F.col("slope_bps")))
    return rows.select("symbol", ep("time_utc").alias("t"), "trend_dir", F.round("trend_bps", 5).alias("trend_bps"), F.round("slope_bps", 5).alias("slope_bps"))


@query("W12_forward_returns", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, " + ", ".join(f"round(lead(close, {h}) OVER w / close - 1, 9) AS fwd_{h}" for h in (1, 3, 6, 12, 24)) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time_utc)")
def w12(spark, folder):
    rows = W.forward_returns(X.bars(spark, folder), (1, 3, 6, 12, 24))
    return rows.select("symbol", ep("time_utc").alias("t"), *[F.round(f"fwd_{h}", 9).alias(f"fwd_{h}") for h in (1, 3, 6, 12, 24)])


@query("P9_warm_up", FEAT, sql=f"SELECT symbol, {EP} AS t FROM feat WHERE rn > 30 AND er IS NOT NULL AND vol_bps IS NOT NULL AND mom_bps IS NOT NULL")
def p9(spark, folder):
    return W.warm(features(spark, folder), 30, ["er", "vol_bps", "mom_bps"]).select("symbol", ep("time_utc").alias("t"))


def gated(spark, folder) -> DataFrame:
    return X.bars(spark, folder).withColumn("gate", F.col("close") >= F.lit(115.0))


@query("W14_confirmation_streak", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, sum(CAST(close >= 115.0 AS INT)) OVER (PARTITION BY symbol ORDER BY time_utc ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS confirmed FROM bars")
def w14(spark, folder):
    return W.streak(gated(spark, folder), "gate", 3, "confirmed").select("symbol", ep("time_utc").alias("t"), "confirmed")


@query("W15_off_streak", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, CASE WHEN g THEN 0 ELSE count(*) FILTER (NOT g) OVER (PARTITION BY symbol, island ORDER BY time_utc) END::BIGINT AS off FROM (SELECT *, sum(CAST(g AS INT)) OVER (PARTITION BY symbol ORDER BY time_utc) AS island FROM (SELECT *, close >= 115.0 AS g FROM bars))")
def w15(spark, folder):
    return W.off_streak(gated(spark, folder), "gate", "off").select("symbol", ep("time_utc").alias("t"), F.col("off").cast("long").alias("off"))


THR = "list_sort(list({0}) FILTER ({0} IS NOT NULL))[least(CAST(floor(count({0}) * {1}::DOUBLE) AS INT), count({0}) - 1) + 1]"


@query("T1_trend_gate", FEAT, sql=f"WITH q AS (SELECT symbol AS s, {THR.format('er', 0.6)} AS a, {THR.format('mom_bps', 0.55)} AS b, {THR.format('mom_bps', 1 - 0.55)} AS c, {THR.format('vol_bps', 0.9)} AS d FROM feat GROUP BY symbol) SELECT symbol, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (er >= a AND vol_bps <= d AND mom_bps >= b) AS BIGINT) AS n_long, CAST(count(*) FILTER (er >= a AND vol_bps <= d AND mom_bps <= c) AS BIGINT) AS n_short FROM feat JOIN q ON s = symbol GROUP BY symbol")
def t1(spark, folder):
    return G.trend_gate(features(spark, folder)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("gate_long").alias("n_long"), F.count_if("gate_short").alias("n_short"))


@query("T2_range_gate", FEAT, sql=f"WITH q AS (SELECT symbol AS s, {THR.format('er', 0.4)} AS a, {THR.format('vol_bps', 0.9)} AS d FROM feat GROUP BY symbol) SELECT symbol, CAST(count(*) FILTER (er <= a AND vol_bps <= d) AS BIGINT) AS n FROM feat JOIN q ON s = symbol GROUP BY symbol")
def t2(spark, folder):
    return G.range_gate(features(spark, folder)).groupBy("symbol").agg(F.count_if("gate").alias("n"))


NEAR = "list_sort(list({0}))[CAST(round((count(*) - 1) * {1}::DOUBLE) AS INT) + 1]"
TAGGED = """parts AS (SELECT symbol, fold_id, 'IS' AS segment, is_start AS a, is_end AS b FROM folds UNION ALL SELECT symbol, fold_id, 'OOS', oos_start, oos_end FROM folds)"""
CALIBRATED = FEAT + ",\n" + SQL_FOLDS + ",\n" + TAGGED + """,
rows1 AS (SELECT feat.*, fold_id, segment FROM feat JOIN parts ON parts.symbol = feat.symbol AND time_utc >= a AND time_utc <= b WHERE er IS NOT NULL AND mom_bps IS NOT NULL AND vol_bps IS NOT NULL),
sizes AS (SELECT symbol, fold_id, count(*) FILTER (segment = 'IS') AS n_is, count(*) FILTER (segment = 'OOS') AS n_oos FROM rows1 GROUP BY ALL),
sch AS (SELECT * FROM (VALUES (0, 'BASE', 0.60::DOUBLE, 0.55::DOUBLE, 0.90::DOUBLE), (1, 'RELAX1', 0.50, 0.50, 0.95), (2, 'RELAX2', 0.40, 0.50, 0.99), (3, 'TIGHT1', 0.70, 0.60, 0.85)) v(rank, scheme, qe, qm, qv)),
lists AS (SELECT symbol, fold_id, count(*) AS n, list_sort(list(er)) AS le, list_sort(list(mom_bps)) AS lm, list_sort(list(vol_bps)) AS lv FROM rows1 WHERE segment = 'IS' GROUP BY ALL),
thr AS (SELECT symbol, fold_id, rank, scheme, side, le[CAST(round((n - 1) * qe) AS INT) + 1] AS thr_er, lv[CAST(round((n - 1) * qv) AS INT) + 1] AS thr_vol,
  CASE WHEN side = 'LONG' THEN greatest(0.0, lm[CAST(round((n - 1) * qm) AS INT) + 1]) ELSE least(0.0, lm[CAST(round((n - 1) * (1 - qm)) AS INT) + 1]) END AS thr_mom FROM lists, sch, (SELECT unnest(['LONG', 'SHORT']) AS side)),
cov AS (SELECT t.symbol, t.fold_id, t.side, rank, scheme, thr_er, thr_mom, thr_vol, avg(p) FILTER (segment = 'IS') AS cov_is, coalesce(avg(p) FILTER (segment = 'OOS'), 0) AS cov_oos
  FROM (SELECT thr.*, segment, CAST(er >= thr_er AND vol_bps <= thr_vol AND CASE WHEN side = 'LONG' THEN mom_bps >= thr_mom ELSE mom_bps <= thr_mom END AS DOUBLE) AS p FROM thr JOIN rows1 USING (symbol, fold_id)) t GROUP BY ALL),
cal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold_id, side ORDER BY cov_is BETWEEN 0.05 AND 0.80 DESC, CASE WHEN cov_is BETWEEN 0.05 AND 0.80 THEN 0 ELSE round(abs(cov_is - 0.30), 9) END, rank) AS rn FROM cov) WHERE rn = 1)"""  # fmt: skip


def calibrated(spark, folder, min_rows: int = 50) -> DataFrame:
    return G.calibrate_trend(features(spark, folder), X.folds(spark, folder), min_rows=min_rows)


@query("T3_calibrated_trend_gate", CALIBRATED, sql="SELECT symbol, fold_id, side, CASE WHEN n_is < 150 THEN 'SKIP' ELSE scheme END AS scheme, CASE WHEN n_is >= 150 THEN round(thr_er, 6) END AS thr_er, CASE WHEN n_is >= 150 THEN round(thr_mom, 6) END AS thr_mom, CASE WHEN n_is >= 150 THEN round(thr_vol, 6) END AS thr_vol, CASE WHEN n_is >= 150 THEN round(cov_is, 6) ELSE 0 END AS cov_is, CASE WHEN n_is >= 150 THEN round(cov_oos, 6) ELSE 0 END AS cov_oos, CAST(n_is AS BIGINT) AS n_is, CAST(n_oos AS BIGINT) AS n_oos FROM cal JOIN sizes USING (symbol, fold_id)")
def t3(spark, folder):
    rows = calibrated(spark, folder, 150)
    return rows.select("symbol", "fold_id", "side", "scheme", *[F.round(c, 6).alias(c) for c in ("thr_er", "thr_mom", "thr_vol", "cov_is", "cov_oos")], "n_is", "n_oos")


@query("J8_regime_lookup", CALIBRATED, sql="SELECT r.symbol, r.fold_id, side, segment, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (er >= thr_er AND vol_bps <= thr_vol AND CASE WHEN side = 'LONG' THEN mom_bps >= thr_mom ELSE mom_bps <= thr_mom END) AS BIGINT) AS passed FROM rows1 r JOIN cal USING (symbol, fold_id) JOIN sizes USING (symbol, fold_id) WHERE n_is >= 50 GROUP BY ALL")
def j8(spark, folder):
    rows = O.tag_segments(features(spark, folder).dropna(subset=["er", "mom_bps", "vol_bps"]), X.folds(spark, folder), "time_utc")
    return G.apply_thresholds(rows, calibrated(spark, folder)).groupBy("symbol", "fold_id", "side", "segment").agg(F.count(F.lit(1)).alias("n"), F.count_if("gate").alias("passed"))


@query("T4_calibrated_range_gate", FEAT, SQL_FOLDS, TAGGED, sql=f"""WITH r AS (SELECT feat.*, fold_id, segment FROM feat JOIN parts ON parts.symbol = feat.symbol AND time_utc >= a AND time_utc <= b WHERE er IS NOT NULL AND vol_bps IS NOT NULL AND range_width_atr IS NOT NULL),
q AS (SELECT symbol, fold_id, {NEAR.format('er', 0.15)} AS x, {NEAR.format('vol_bps', 0.60)} AS y, {NEAR.format('range_width_atr', 0.80)} AS z FROM r WHERE segment = 'IS' GROUP BY ALL)
SELECT symbol, fold_id, round(x, 6) AS thr_er, round(y, 6) AS thr_vol, round(z, 6) AS thr_width, round(avg(CAST(er <= x AND vol_bps <= y AND range_width_atr <= z AS DOUBLE)) FILTER (segment = 'IS'), 6) AS cov_is, round(coalesce(avg(CAST(er <= x AND vol_bps <= y AND range_width_atr <= z AS DOUBLE)) FILTER (segment = 'OOS'), 0), 6) AS cov_oos FROM r JOIN q USING (symbol, fold_id) GROUP BY symbol, fold_id, x, y, z""")  # fmt: skip
def t4(spark, folder):
    rows = G.calibrate_range(features(spark, folder), X.folds(spark, folder))
    return rows.select("symbol", "fold_id", *[F.round(c, 6).alias(c) for c in ("thr_er", "thr_vol", "thr_width", "cov_is", "cov_oos")])


@query("T5_mean_reversion", FEAT, sql="SELECT symbol, CAST(count(*) FILTER (round(dist_mean_atr, 9) <= -0.5 AND round(dist_vel_3, 9) > 0.1) AS BIGINT) AS n_long, CAST(count(*) FILTER (round(dist_mean_atr, 9) >= 0.5 AND round(dist_vel_3, 9) < -0.1) AS BIGINT) AS n_short FROM feat GROUP BY symbol")
def t5(spark, folder):
    rows = features(spark, folder).withColumns({c: F.round(c, 9) for c in ("dist_mean_atr", "dist_vel_3")})
    return G.mean_reversion(rows, 0.5).groupBy("symbol").agg(F.count_if("signal_long").alias("n_long"), F.count_if("signal_short").alias("n_short"))


@query("T17_fold_table", X.SQL_TICKS, SQL_FOLDS, sql="SELECT symbol, fold_id, " + ", ".join(f"CAST(epoch({c}) AS BIGINT) AS {c}" for c in ("is_start", "is_end", "oos_start", "oos_end")) + ", oos_start >= coalesce(lag(oos_end) OVER (PARTITION BY symbol ORDER BY oos_start), oos_start) AS ok FROM folds")
def t17(spark, folder):
    return O.non_overlapping(X.folds(spark, folder)).select("symbol", "fold_id", *[ep(c).alias(c) for c in ("is_start", "is_end", "oos_start", "oos_end")], "ok")


def order_bounds(spark, folder) -> DataFrame:
    o = X.table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.date_trunc("day", F.min("o_orderdate")).alias("first"), F.date_trunc("day", F.max("o_orderdate")).alias("last"))


BOUNDS = "bounds AS (SELECT o_orderpriority AS symbol, date_trunc('day', min(o_orderdate)) AS first, date_trunc('day', max(o_orderdate)) AS last FROM orders GROUP BY 1), ks AS (SELECT unnest(generate_series(0, 60)) AS k)"
FOLD_COLUMNS = ", ".join(f"CAST(epoch({c}) AS BIGINT) AS {c}" for c in ("is_start", "is_end", "oos_start", "oos_end"))


@query("T17_fold_table_calendar_months", BOUNDS, sql=f"SELECT symbol, fold_id, {FOLD_COLUMNS} FROM (SELECT symbol, last, printf('F%02d', k) AS fold_id, m + to_months(CAST(3 * k AS INT)) AS is_start, m + to_months(CAST(3 * k + 12 AS INT)) AS is_end, m + to_months(CAST(3 * k + 12 AS INT)) + INTERVAL 7 DAY AS oos_start, m + to_months(CAST(3 * k + 15 AS INT)) + INTERVAL 7 DAY AS oos_end FROM (SELECT *, date_trunc('month', first) AS m FROM bounds), ks) WHERE oos_end <= last")
def t17_calendar(spark, folder):
    return O.calendar_month_folds(order_bounds(spark, folder), 12, 3, 3, 7 * 86400).select("symbol", "fold_id", *[ep(c).alias(c) for c in ("is_start", "is_end", "oos_start", "oos_end")])


@query("T17_fold_table_fixed_months", BOUNDS, sql=f"SELECT symbol, fold_id, {FOLD_COLUMNS} FROM (SELECT symbol, last, printf('F%02d', k) AS fold_id, first + to_days(CAST(90 * k AS INT)) AS is_start, first + to_days(CAST(90 * k + 360 AS INT)) AS is_end, first + to_days(CAST(90 * k + 365 AS INT)) AS oos_start, first + to_days(CAST(90 * k + 455 AS INT)) AS oos_end FROM bounds, ks) WHERE oos_end <= last")
def t17_fixed(spark, folder):
    return O.fixed_month_folds(order_bounds(spark, folder), 12, 3, 3, 5, 30.0).select("symbol", "fold_id", *[ep(c).alias(c) for c in ("is_start", "is_end", "oos_start", "oos_end")])


@query("J5_segment_tags", SQL_BARS, SQL_FOLDS, TAGGED, sql="SELECT bars.symbol, fold_id, segment, CAST(count(*) AS BIGINT) AS n FROM bars JOIN parts ON parts.symbol = bars.symbol AND time_utc >= a AND time_utc <= b GROUP BY ALL")
def j5(spark, folder):
    return O.tag_segments(X.bars(spark, folder), X.folds(spark, folder), "time_utc").groupBy("symbol", "fold_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("A21_fold_counts", SQL_BARS, SQL_FOLDS, sql=f"SELECT symbol, fold_id, CAST(count(*) FILTER (time_utc >= is_start AND time_utc < is_end) AS BIGINT) AS is_bars, CAST(count(*) FILTER (time_utc >= oos_start AND time_utc < oos_end) AS BIGINT) AS oos_bars, CAST(count(DISTINCT {DAY}) FILTER (time_utc >= is_start AND time_utc < is_end) AS BIGINT) AS is_days, CAST(count(DISTINCT {DAY}) FILTER (time_utc >= oos_start AND time_utc < oos_end) AS BIGINT) AS oos_days FROM bars JOIN folds USING (symbol) GROUP BY ALL")
def a21(spark, folder):
    return O.fold_counts(X.bars(spark, folder), X.folds(spark, folder))


@query("F16_terciles", FEAT, sql="SELECT symbol, CASE WHEN er IS NULL THEN NULL WHEN er <= q.a THEN 'low' WHEN er <= q.b THEN 'mid' ELSE 'high' END AS regime, CAST(count(*) AS BIGINT) AS n FROM feat, (SELECT quantile_cont(er, 0.333) AS a, quantile_cont(er, 0.667) AS b FROM feat) q GROUP BY ALL")
def f16(spark, folder):
    return G.terciles(features(spark, folder), "er", "regime").groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


@query("F17_winsorise", SQL_BARS, sql=f"SELECT symbol, {DAY} AS d, greatest(-0.10, least(0.10, close / lag(close) OVER (PARTITION BY symbol ORDER BY {DAY}) - 1)) * CASE WHEN symbol = 'VIEW' THEN -1 ELSE 1 END AS ret FROM (SELECT symbol, date_trunc('day', time_utc) AS time_utc, last(close ORDER BY time_utc) AS close FROM bars GROUP BY symbol, date_trunc('day', time_utc))")
def f17(spark, folder):
    from barloom.operators.metrics import winsorise
    from barloom.sources.bars import daily_close

    rows = daily_close(X.bars(spark, folder)).withColumn("side", F.when(F.col("symbol") == "VIEW", "SHORT").otherwise("LONG"))
    return winsorise(rows, 0.10).select("symbol", day().alias("d"), "ret")


@query("T14_recosting", SQL_TRADES, sql="SELECT symbol, k1, k2, k3, gross_pnl - CASE symbol WHEN 'A' THEN 3.0 ELSE 8.0 END / 10000 AS net_base, gross_pnl - CASE symbol WHEN 'A' THEN 6.0 ELSE 16.0 END / 10000 AS net_stress, symbol = 'A' AS cost_known FROM trades")
def t14(spark, folder):
    known = spark.sql("SELECT 'A' AS symbol, 3.0D AS base_bps, 6.0D AS stress_bps")
    return C.recost(X.trades(spark, folder), known).select("symbol", "k1", "k2", "k3", "net_base", "net_stress", "cost_known")



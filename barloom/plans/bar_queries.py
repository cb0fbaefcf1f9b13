"""Queries over bars: sources, cleaning, sets, quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.plans.registry import query
from barloom.scratch import scratch_folder
from barloom.sources import bars as B
from barloom.sources import fixtures as X
from barloom.sources.fixtures import EXPECTED_BARS, SQL_BARS, SQL_RAW

ep = F.unix_timestamp
DAY = "CAST(epoch(date_trunc('day', time_utc)) AS BIGINT)"
EP = "CAST(epoch(time_utc) AS BIGINT)"


def day(c: str | Column = "day") -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def canonical(df: DataFrame) -> DataFrame:
    return df.select("symbol", ep("time_utc").alias("t"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), F.col("spread").cast("double").alias("spread"))


def _stored(spark: SparkSession, folder: str) -> str:
    place = scratch_folder(spark, "store")
    B.write_bars(X.bars(spark, folder), place)
    return place


CANON = f"SELECT symbol, {EP} AS t, open, high, low, close, volume, spread FROM bars"
LAST = "SELECT symbol, CAST(timestamp_utc / 1000 AS BIGINT) AS t, open, high, low, close, tick_volume AS volume, spread_points AS spread FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp_utc ORDER BY ingest_seq {}) AS rn FROM raw) WHERE rn = 1"


@query("S1_load_bars", SQL_RAW, sql=LAST.format("DESC") + " AND symbol IN ('CLICK', 'VIEW')")
def s1(spark, folder):
    place = scratch_folder(spark, "flat")
    X.raw_bars(spark, folder).write.parquet(place)
    return canonical(B.load_bars(spark, place, ["click", " view"], order=["ingest_seq"]))


@query("S2_load_partitioned", SQL_BARS, sql=CANON + " WHERE symbol = 'CLICK'")
def s2(spark, folder):
    return canonical(B.load_partitioned(spark, _stored(spark, folder), ["click"]))


@query("S3_load_features", SQL_BARS, sql=CANON)
def s3(spark, folder):
    place = scratch_folder(spark, "features")
    X.bars(spark, folder).write.parquet(place)
    return canonical(B.load_features(spark, place))


@query("S4_rename_columns", SQL_RAW, sql="SELECT symbol, timestamp_utc AS time_utc, open, high, low, close, tick_volume AS volume, spread_points AS spread, CAST(ingest_seq AS INT) AS ingest_seq FROM raw")
def s4(spark, folder):
    return B.rename_columns(X.raw_bars(spark, folder)).select("symbol", "time_utc", "open", "high", "low", "close", "volume", "spread", "ingest_seq")


@query("S5_epoch_coercion", sql="SELECT event_id, u AS unit, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events, (SELECT unnest(['s', 'ms', 'us', 'ns']) AS u)")
def s5(spark, folder):
    e = X.table(spark, folder, "events").select("event_id", F.unix_timestamp("ts").alias("s"))
    units = F.create_map(F.lit("s"), F.col("s"), F.lit("ms"), F.col("s") * 1000, F.lit("us"), F.col("s") * 1000000, F.lit("ns"), F.col("s") * 1000000000)
    rows = e.select("event_id", F.explode(units).alias("unit", "time_utc"))
    return B.canonical_time(rows).select("event_id", "unit", ep("time_utc").alias("t"))


@query("S6_resolve_columns", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, open, high, low, close, volume, 0.0::DOUBLE AS spread FROM bars")
def s6(spark, folder):
    odd = X.bars(spark, folder).select(F.col("symbol").alias("Ticker"), F.col("time_utc").alias("DateTime"), F.col("open").alias("O"), F.col("high").alias("H"), F.col("low").alias("L"), F.col("close").alias("C"), F.col("volume").alias("Vol"))
    return canonical(B.resolve_columns(odd))


@query("S7_project_source", SQL_BARS, sql=f"SELECT symbol, {EP} * 1000 AS timestamp_utc, strftime(time_utc + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, close, CAST(volume AS BIGINT) AS tick_volume, true AS real_volume_missing, 'Etc/GMT-2' AS server_tz FROM bars")
def s7(spark, folder):
    source = X.bars(spark, folder).select("symbol", ep("time_utc").alias("time"), "open", "high", "low", "close", F.col("volume").alias("tick_volume"), "spread")
    rows = B.project_source(source, "Etc/GMT-2", "demo")
    return rows.select("symbol", "timestamp_utc", F.date_format("timestamp_local", "yyyy-MM-dd HH:mm:ss").alias("local_time"), "close", "tick_volume", F.col("real_volume").isNull().alias("real_volume_missing"), "server_tz")


@query("S8_enforce_contract", SQL_RAW, sql="SELECT timestamp_utc, symbol, close, CAST(tick_volume AS BIGINT) AS tick_volume, true AS real_volume_missing, spread_points, true AS broker_missing, CAST(ingest_seq AS INT) AS ingest_seq FROM raw")
def s8(spark, folder):
    return B.enforce_contract(X.raw_bars(spark, folder)).select("timestamp_utc", "symbol", "close", "tick_volume", F.col("real_volume").isNull().alias("real_volume_missing"), "spread_points", F.col("broker").isNull().alias("broker_missing"), "ingest_seq")


@query("S9_required_columns", SQL_BARS, sql="SELECT CAST(count(*) AS BIGINT) AS n FROM bars")
def s9(spark, folder):
    return B.require_columns(X.bars(spark, folder), B.BAR_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


@query("S10_bars_sink", SQL_BARS, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n, round(sum(close), 4) AS close FROM (SELECT symbol, close + CASE WHEN time_utc >= TIMESTAMP '2024-01-10' AND time_utc < TIMESTAMP '2024-01-11' THEN 1 ELSE 0 END AS close FROM bars) GROUP BY symbol")
def s10(spark, folder):
    """Twice the same bars (the second time skipped), then one day forced."""
    bars = X.bars(spark, folder)
    place = scratch_folder(spark, "sink")
    B.write_bars(bars, place)
    again = bars.withColumn("close", F.col("close") + 1)
    B.write_bars(again, place)
    forced = bars.select("symbol", F.to_date(F.lit("2024-01-10")).alias("day")).distinct()
    B.write_bars(again, place, forced)
    return B.read_store(spark, place).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("close"))


@query("S11_run_log", sql="SELECT event_id, 'out/' || event_id AS path FROM events WHERE user_id % 2 = 0 AND event_type = 'click' UNION ALL SELECT event_id, 'in/' || event_id FROM events WHERE user_id % 2 = 1 AND event_type = 'click'")
def s11(spark, folder):
    e = X.table(spark, folder, "events")
    place = scratch_folder(spark, "log")
    log = e.select("event_id", F.col("event_type").alias("run_id"), F.concat(F.lit("in/"), F.col("event_id").cast("string")).alias("path"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("out/"), F.col("event_id").cast("string"))).alias("dst"))
    log.write.json(place)
    return B.run_log(spark, place, "click").select("event_id", "path")


@query("S12_trade_sinks", X.SQL_TRADES, sql="SELECT f AS format, CAST(count(*) AS BIGINT) AS n, round(sum(gross_pnl), 4) AS gross FROM trades, (SELECT unnest(['csv', 'parquet']) AS f) GROUP BY f")
def s12(spark, folder):
    rows = X.trades(spark, folder)
    a, b = scratch_folder(spark, "trades"), scratch_folder(spark, "trades")
    rows.write.parquet(a)
    rows.write.csv(b, header=True)
    back = spark.read.parquet(a).select("gross_pnl").withColumn("format", F.lit("parquet")).unionByName(spark.read.csv(b, header=True).select(F.col("gross_pnl").cast("double")).withColumn("format", F.lit("csv")))
    return back.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gross_pnl"), 4).alias("gross"))


@query("S13_json_snapshot", SQL_BARS, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n, CAST(count(prev) AS BIGINT) AS with_ret, min(strftime(time_utc, '%Y-%m-%dT%H:%M:%S')) AS first FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time_utc) AS prev FROM bars) GROUP BY symbol")
def s13(spark, folder):
    from barloom.operators.features import returns

    place = scratch_folder(spark, "json")
    rows = returns(X.bars(spark, folder)).withColumn("ret", F.coalesce("ret", F.lit(float("nan"))))
    B.snapshot_json(rows.select("symbol", "time_utc", "close", "ret")).write.text(place)
    back = spark.read.text(place).select(F.from_json("value", "symbol string, time_utc string, close double, ret double").alias("j")).select("j.*")
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("ret").alias("with_ret"), F.min("time_utc").alias("first"))


@query("S16_instrument_snapshot", X.SQL_QUOTES, sql="SELECT symbol, path, bid, ask, contract_size, visible, trade_mode, 'run-1' AS run_id FROM quotes")
def s16(spark, folder):
    return B.instrument_snapshot(X.quotes(spark, folder), "run-1", F.lit("2024-01-31").cast("timestamp")).select("symbol", "path", "bid", "ask", "contract_size", "visible", "trade_mode", "run_id")


@query("S17_symbol_list", SQL_BARS, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM bars WHERE symbol LIKE '%C%' GROUP BY symbol")
def s17(spark, folder):
    bars, place = X.bars(spark, folder), scratch_folder(spark, "list")
    bars.where("symbol like '%C%'").select(F.concat(F.lit("  "), F.lower("symbol"), F.lit(" \n")).alias("value")).distinct().write.text(place)
    return Q.filter_universe(bars, B.symbol_list(spark, place)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("S19_file_fingerprints")
def s19(spark, folder):
    place = f"{_stored(spark, folder)}/data"
    now = B.fingerprints(spark, place)
    return B.changed_files(now, now.withColumn("logged_at", F.lit(1))).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("P1_equality_filters", X.SQL_TRADES, sql="SELECT symbol, side, exit_reason, CAST(count(*) AS BIGINT) AS n FROM trades WHERE symbol IN ('A', 'R') AND side = 'LONG' AND segment = 'OOS' AND exit_reason <> 'TIME' GROUP BY ALL")
def p1(spark, folder):
    rows = X.trades(spark, folder).where(F.col("symbol").isin("A", "R") & (F.col("side") == "LONG") & (F.col("segment") == "OOS") & (F.col("exit_reason") != "TIME"))
    return rows.groupBy("symbol", "side", "exit_reason").agg(F.count(F.lit(1)).alias("n"))


DIRTY = (
    SQL_RAW
    + """,
dirty AS (SELECT timestamp_utc, symbol, CASE WHEN timestamp_utc / 3600000 % 37 = 0 THEN 'oops' ELSE CAST(open AS VARCHAR) END AS open, high,
  CASE WHEN timestamp_utc / 3600000 % 41 = 0 THEN high + 1 ELSE low END AS low, CASE WHEN timestamp_utc / 3600000 % 43 = 0 THEN CAST('nan' AS DOUBLE) ELSE close END AS close, tick_volume, spread_points, ingest_seq FROM raw),
cast1 AS (SELECT * REPLACE (TRY_CAST(open AS DOUBLE) AS open, CASE WHEN NOT isnan(close) THEN close END AS close) FROM dirty)"""
)


def _dirty(spark, folder) -> DataFrame:
    hour = F.col("timestamp_utc") / 3600000
    return X.raw_bars(spark, folder).withColumns({
        "open": F.when(hour % 37 == 0, "oops").otherwise(F.col("open").cast("string")), "low": F.when(hour % 41 == 0, F.col("high") + 1).otherwise(F.col("low")), "close": F.when(hour % 43 == 0, float("nan")).otherwise(F.col("close")),
    })


@query("P2_drop_null_rows", DIRTY, sql="SELECT symbol, timestamp_utc, low, high, ingest_seq FROM cast1 WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND low <= high")
def p2(spark, folder):
    rows = _dirty(spark, folder).withColumns({c: B.to_number(c) for c in B.PRICES})
    return rows.dropna(subset=["symbol", "timestamp_utc", *B.PRICES]).where("low <= high").select("symbol", "timestamp_utc", "low", "high", "ingest_seq")


@query("P3_lossy_casts", DIRTY, sql="SELECT symbol, timestamp_utc, ingest_seq, open, close FROM cast1")
def p3(spark, folder):
    return _dirty(spark, folder).select("symbol", "timestamp_utc", "ingest_seq", B.to_number("open").alias("open"), B.to_number("close").alias("close"))


@query("P4_clean_bars", DIRTY, sql="SELECT symbol, timestamp_utc, open, high, low, close, CAST(tick_volume AS BIGINT) AS tick_volume, ingest_seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp_utc ORDER BY ingest_seq DESC) AS rn FROM cast1 WHERE open IS NOT NULL AND close IS NOT NULL AND low <= high) WHERE rn = 1")
def p4(spark, folder):
    return B.clean_bars(_dirty(spark, folder)).select("symbol", "timestamp_utc", "open", "high", "low", "close", "tick_volume", "ingest_seq")


@query("P5_bad_value_flags", DIRTY, sql="SELECT symbol, bool_or(TRY_CAST(open AS DOUBLE) IS NULL) AS any_null, bool_or(isnan(close)) AS any_nan, bool_or(low > high) AS low_gt_high FROM dirty GROUP BY symbol")
def p5(spark, folder):
    rows = _dirty(spark, folder).withColumns({"open": F.col("open").try_cast("double"), "time_utc": B.epoch_to_timestamp(F.col("timestamp_utc")), "spread": F.col("spread_points")})
    days = Q.daily_qa(rows, EXPECTED_BARS)
    return days.groupBy("symbol").agg(F.bool_or("has_null").alias("any_null"), F.bool_or("has_nan").alias("any_nan"), F.bool_or("low_gt_high").alias("low_gt_high"))


@query("J12_dedup_keep_last", SQL_RAW, sql=LAST.format("DESC"))
def j12(spark, folder):
    return canonical(B.normalise(X.raw_bars(spark, folder), order=["ingest_seq"]))


@query("J12_dedup_keep_first", SQL_RAW, sql=LAST.format("ASC"))
def j12_first(spark, folder):
    return canonical(B.normalise(X.raw_bars(spark, folder), order=["ingest_seq"], keep="first"))


@query("U1_union_relaxed", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, close, spread FROM bars UNION ALL SELECT symbol, {EP}, close, NULL FROM bars")
def u1(spark, folder):
    bars = X.bars(spark, folder).select("symbol", ep("time_utc").alias("t"), "close", "spread")
    return bars.unionByName(bars.drop("spread"), allowMissingColumns=True)


@query("U2_intersect", SQL_BARS, sql="SELECT symbol FROM bars WHERE close > 150 INTERSECT SELECT symbol FROM bars WHERE volume >= 2")
def u2(spark, folder):
    bars = X.bars(spark, folder)
    return bars.where("close > 150").select("symbol").intersect(bars.where("volume >= 2").select("symbol"))


@query("U3_except", SQL_BARS, sql=f"SELECT symbol, {EP} AS t FROM bars EXCEPT ALL SELECT symbol, {EP} FROM bars WHERE volume >= 2")
def u3(spark, folder):
    rows = X.bars(spark, folder)
    return rows.select("symbol", ep("time_utc").alias("t")).exceptAll(rows.where("volume >= 2").select("symbol", ep("time_utc").alias("t")))


@query("U4_distinct", SQL_BARS, sql=f"SELECT DISTINCT symbol, {DAY} AS d FROM bars")
def u4(spark, folder):
    return X.bars(spark, folder).select("symbol", day(F.to_date("time_utc")).alias("d")).distinct()


@query("U5_upsert", SQL_BARS, sql="SELECT symbol, CASE WHEN symbol = 'CLICK' THEN -1 ELSE CAST(count(*) AS BIGINT) END AS n_bars FROM bars GROUP BY symbol")
def u5(spark, folder):
    known = Q.catalog(X.bars(spark, folder)).select("symbol", "n_bars")
    return B.upsert(known, known.where("symbol = 'CLICK'").withColumn("n_bars", F.lit(-1).cast("long")))


@query("U6_layer_priority", SQL_BARS, sql=f"SELECT symbol, {DAY} AS d, CAST(count(*) AS BIGINT) AS n, CASE WHEN epoch(time_utc)::BIGINT // 86400 % 3 = 0 THEN 0 WHEN epoch(time_utc)::BIGINT // 86400 % 2 = 0 THEN 1 ELSE 2 END AS layer FROM bars GROUP BY ALL")
def u6(spark, folder):
    rows = X.bars(spark, folder).withColumn("day", F.to_date("time_utc"))
    k = F.datediff("day", F.lit("1970-01-01").cast("date"))
    best = B.by_priority([rows.where(k % 3 == 0), rows.where(k % 2 == 0), rows])
    return best.groupBy("symbol", day().alias("d"), F.col("layer").cast("int").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("U7_work_list", SQL_BARS, sql=f"""SELECT symbol, d, max(reason) AS reason FROM (
  SELECT w.symbol, w.d, CASE WHEN w.d > w.last THEN 'TAIL' ELSE 'GAP' END AS reason FROM (SELECT symbol, max({DAY}) AS last, unnest(generate_series(min({DAY}), greatest(1706745600, min({DAY})), 86400)) AS d FROM bars WHERE {EP} % 5 <> 0 OR hour(time_utc) > 20 GROUP BY symbol) w
    ANTI JOIN (SELECT DISTINCT symbol, {DAY} AS d FROM bars WHERE hour(time_utc) > 20) p ON p.symbol = w.symbol AND p.d = w.d WHERE w.d <= 1706745600
  UNION ALL SELECT DISTINCT symbol, 1704844800, 'REPROCESS' FROM bars UNION ALL SELECT 'CLICK', 1704931200, 'REPROCESS') GROUP BY symbol, d""".replace(f"WHERE {EP} % 5 <> 0 OR hour(time_utc) > 20", "WHERE hour(time_utc) > 20"))  # fmt: skip
def u7(spark, folder):
    bars = X.bars(spark, folder)
    present = bars.where(F.hour("time_utc") > 20).select("symbol", F.to_date("time_utc").alias("day"))
    again = spark.sql("SELECT '*' AS symbol, DATE '2024-01-10' AS day UNION ALL SELECT 'CLICK', DATE '2024-01-11' UNION ALL SELECT 'CLICK', DATE '2024-03-01'")
    return B.work_list(present, bars, F.to_date(F.lit("2024-02-01")), again).select("symbol", day().alias("d"), "reason")


@query("W21_daily_close", SQL_BARS, sql=f"SELECT symbol, d, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret FROM (SELECT symbol, {DAY} AS d, last(close ORDER BY time_utc) AS close FROM bars GROUP BY ALL)")
def w21(spark, folder):
    return B.daily_close(X.bars(spark, folder)).select("symbol", day().alias("d"), "close", "ret")


WINDOWED = SQL_BARS + """,
layered AS (SELECT *, 'gold' AS layer FROM bars WHERE day(time_utc) % 2 = 0 UNION ALL SELECT *, 'raw' FROM bars WHERE day(time_utc) % 2 = 1),
windowed AS (SELECT layered.*, w AS window_days FROM layered, (SELECT unnest([5, 10, 20]) AS w) WHERE CAST(time_utc AS DATE) > DATE '2024-01-30' - CAST(w AS INT) AND CAST(time_utc AS DATE) <= DATE '2024-01-30')"""  # fmt: skip


def _windowed(spark, folder) -> DataFrame:
    bars = X.bars(spark, folder)
    return B.trailing_windows(bars.where(F.day("time_utc") % 2 == 0), bars, F.to_date(F.lit("2024-01-30")), (5, 10, 20))


@query("W22_trailing_windows", WINDOWED, sql="SELECT symbol, CAST(window_days AS INT) AS window_days, layer, CAST(count(*) AS BIGINT) AS n, round(sum(close), 6) AS close FROM windowed GROUP BY ALL")
def w22(spark, folder):
    return _windowed(spark, folder).groupBy("symbol", "window_days", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 6).alias("close"))


QA_DAYS = SQL_BARS + f""",
days0 AS (SELECT symbol, {DAY} AS d, count(*) AS n_bars, count(DISTINCT time_utc) AS n_unique_ts, median(spread) AS spread_p50, median(bps) AS spread_bps_p50, quantile_cont(bps, 0.9) AS spread_bps_p90,
  coalesce(avg(CAST(ret = 0 AS DOUBLE)), 0.0) AS zero_share, max(abs(ret)) AS max_ret
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol, date_trunc('day', time_utc) ORDER BY time_utc) - 1 AS ret, spread / close * 10000 AS bps FROM bars) GROUP BY ALL),
days1 AS (SELECT *, n_bars - n_unique_ts AS dups, round(100.0 * n_unique_ts / 24, 6) AS grid_pct, CASE WHEN n_bars < 2 THEN 'EMPTY' WHEN coalesce(max_ret, 0.0) >= 0.5 OR zero_share >= 0.8 THEN 'BAD' ELSE 'OK' END AS price_flag FROM days0),
days AS (SELECT *, CASE WHEN n_bars < 2 THEN 'EMPTY' WHEN dups > 0 THEN 'FAIL' WHEN grid_pct < 90 OR price_flag = 'BAD' THEN 'WARN' ELSE 'OK' END AS status,
  concat_ws(',', CASE WHEN dups > 0 THEN 'DUPS' END, CASE WHEN grid_pct < 90 THEN 'LOW_GRID' END, CASE WHEN coalesce(max_ret, 0.0) >= 0.5 OR zero_share >= 0.8 THEN 'PRICE' END) AS notes FROM days1)"""  # fmt: skip


def _days(spark, folder) -> DataFrame:
    return Q.daily_qa(X.bars(spark, folder), EXPECTED_BARS)


@query("A2_daily_qa", QA_DAYS, sql="SELECT symbol, d, n_bars, n_unique_ts, dups, grid_pct, spread_p50, spread_bps_p50, round(spread_bps_p90, 6) AS spread_bps_p90, zero_share, max_ret, status, notes FROM days")
def a2(spark, folder):
    return _days(spark, folder).select("symbol", day().alias("d"), "n_bars", "n_unique_ts", "dups", "grid_pct", "spread_p50", "spread_bps_p50", F.round("spread_bps_p90", 6).alias("spread_bps_p90"), "zero_share", "max_ret", "status", "notes")


@query("A3_price_sanity", QA_DAYS, sql="SELECT symbol, price_flag, CAST(count(*) AS BIGINT) AS n, max(max_ret) AS worst FROM days GROUP BY ALL")
def a3(spark, folder):
    return _days(spark, folder).groupBy("symbol", "price_flag").agg(F.count(F.lit(1)).alias("n"), F.max("max_ret").alias("worst"))


SYMBOLS = QA_DAYS + """,
sym0 AS (SELECT symbol, count(*) AS n_days, count(*) FILTER (status = 'OK') AS ok_days, count(*) FILTER (status = 'WARN') AS warn_days, count(*) FILTER (status = 'FAIL') AS fail_days, count(*) FILTER (status = 'EMPTY') AS empty_days,
  count(*) FILTER (price_flag = 'BAD') AS bad_price_days, avg(n_bars) AS mean_bars, median(n_bars) AS median_bars, avg(grid_pct) AS mean_grid, median(grid_pct) AS median_grid FROM days GROUP BY symbol),
sym1 AS (SELECT *, fail_days / n_days AS fail_ratio, ok_days / n_days AS ok_ratio, bad_price_days / n_days AS bad_price_ratio, CASE WHEN median_grid >= 90 THEN '24H' WHEN median_grid >= 25 THEN 'DIURNA' ELSE 'ILLQ' END AS session_type FROM sym0),
sym AS (SELECT *, CASE WHEN fail_ratio > 0.05 THEN 'BAD_STRUCT' WHEN fail_ratio > 0 THEN 'WARN_STRUCT' ELSE 'OK_STRUCT' END AS qa_struct_flag,
  CASE WHEN session_type = '24H' THEN CASE WHEN mean_grid >= 95 THEN 'OK' WHEN mean_grid >= 85 THEN 'WARN' ELSE 'BAD' END WHEN session_type = 'DIURNA' THEN CASE WHEN mean_grid >= 60 THEN 'OK' WHEN mean_grid >= 30 THEN 'WARN' ELSE 'BAD' END ELSE 'BAD' END AS qa_operativa_flag,
  CASE WHEN bad_price_ratio > 0.10 THEN 'BAD' WHEN bad_price_ratio > 0.02 THEN 'WARN' ELSE 'OK' END AS qa_price_flag FROM sym1)"""  # fmt: skip


@query("A4_symbol_qa", SYMBOLS, sql="SELECT symbol, n_days, ok_days, warn_days, fail_days, empty_days, mean_bars, median_bars, round(mean_grid, 6) AS mean_grid, median_grid, fail_ratio, ok_ratio FROM sym")
def a4(spark, folder):
    return Q.symbol_qa(_days(spark, folder)).select("symbol", "n_days", "ok_days", "warn_days", "fail_days", "empty_days", "mean_bars", "median_bars", F.round("mean_grid", 6).alias("mean_grid"), "median_grid", "fail_ratio", "ok_ratio")


@query("A5_symbol_flags", SYMBOLS, sql="SELECT symbol, session_type, qa_struct_flag, qa_operativa_flag, qa_price_flag FROM sym")
def a5(spark, folder):
    return Q.symbol_qa(_days(spark, folder)).select("symbol", "session_type", "qa_struct_flag", "qa_operativa_flag", "qa_price_flag")


@query("A6_coverage_gate", QA_DAYS, sql="SELECT avg(n_bars) AS mean_bars, median(n_bars) AS median_bars, round(avg(grid_pct), 6) AS mean_grid, median(grid_pct) AS median_grid, (avg(n_bars) < 6 AND median(n_bars) < 6) OR (avg(grid_pct) < 25 AND median(grid_pct) < 25) AS hard_fail FROM days")
def a6(spark, folder):
    return Q.coverage_gate(_days(spark, folder), 6, 25).withColumn("mean_grid", F.round("mean_grid", 6))


DQ = """dq0 AS (SELECT symbol, min(d) AS first_day, max(d) AS last_day, count(*) AS days_present, sum(candles) AS candles, count(*) FILTER (candles < 12) AS gap_days, date_diff('day', min(d), max(d)) + 1 AS days_span
  FROM (SELECT symbol, CAST(time_utc + INTERVAL 2 HOUR AS DATE) AS d, count(*) AS candles FROM bars GROUP BY ALL) GROUP BY symbol),
dq AS (SELECT *, least(100.0, 100.0 * candles / (days_span * 24)) AS coverage_pct, greatest(0.0, 100.0 - least(100.0, 100.0 * candles / (days_span * 24))) AS missing_pct,
  round(greatest(0, least(100, 0.6 * CAST(least(100.0, 100.0 * candles / (days_span * 24)) AS DOUBLE) + 0.3 * (CAST(100.0 * days_present / days_span AS DOUBLE)) + 0.1 * (100.0 - CAST(100.0 * gap_days / days_present AS DOUBLE)))), 2) AS score FROM dq0)"""


@query("A7_data_quality_score", SQL_BARS, DQ, sql="SELECT symbol, days_present, CAST(candles AS BIGINT) AS candles, gap_days, CAST(days_span AS BIGINT) AS days_span, CAST(coverage_pct AS DOUBLE) AS coverage_pct, CAST(missing_pct AS DOUBLE) AS missing_pct, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 80 THEN 'OK' WHEN score >= 60 THEN 'WARNING' ELSE 'BAD' END AS dq_flag FROM dq")
def a7(spark, folder):
    return Q.data_quality(X.bars(spark, folder), EXPECTED_BARS, 2).select("symbol", "days_present", "candles", "gap_days", F.col("days_span").cast("long").alias("days_span"), "coverage_pct", "missing_pct", "score", "dq_flag")


@query("P13_universe", SYMBOLS, DQ, sql="SELECT sym.symbol, session_type, sym.symbol <> 'ERROR' AS keep_by_cost, CAST(score AS DOUBLE) AS score, CASE WHEN sym.symbol <> 'ERROR' AND qa_operativa_flag IN ('OK', 'WARN') AND qa_struct_flag <> 'BAD_STRUCT' AND qa_price_flag <> 'BAD' AND score >= 60 THEN 'IN' ELSE 'OUT' END AS universe_flag FROM sym JOIN dq USING (symbol)")
def p13(spark, folder):
    bars = X.bars(spark, folder)
    out = Q.universe(Q.symbol_qa(Q.daily_qa(bars, EXPECTED_BARS)), Q.data_quality(bars, EXPECTED_BARS, 2), bars.where("symbol <> 'ERROR'"))
    return out.select("symbol", "session_type", "keep_by_cost", "score", "universe_flag")


@query("A8_catalog", SQL_BARS, sql=f"SELECT symbol, CAST(count(*) AS BIGINT) AS n_bars, CAST(count(DISTINCT {DAY}) AS BIGINT) AS n_days, min({EP}) AS first_ts, max({EP}) AS last_ts, CAST(1 AS INT) AS months_span FROM bars GROUP BY symbol")
def a8(spark, folder):
    return Q.catalog(X.bars(spark, folder)).select("symbol", "n_bars", "n_days", ep("first_ts").alias("first_ts"), ep("last_ts").alias("last_ts"), "months_span")


@query("A9_file_manifest", SQL_BARS, sql=f"SELECT symbol, CAST(count(*) AS BIGINT) AS rows, min({EP}) AS min_ts, max({EP}) AS max_ts FROM bars GROUP BY symbol")
def a9(spark, folder):
    stored = B.read_store(spark, _stored(spark, folder))
    return Q.file_manifest(stored).groupBy("symbol").agg(F.sum("rows").alias("rows"), F.min(ep("min_ts")).alias("min_ts"), F.max(ep("max_ts")).alias("max_ts"))


@query("A10_day_index", SQL_RAW, sql="SELECT symbol, CAST(timestamp_utc // 86400000 * 86400 AS BIGINT) AS d, CAST(count(*) AS BIGINT) AS rows, CAST(min(timestamp_utc) // 1000 AS BIGINT) AS min_ts, CAST(max(timestamp_utc) // 1000 AS BIGINT) AS max_ts, CAST(count(*) - count(DISTINCT timestamp_utc) AS BIGINT) AS dups FROM raw GROUP BY ALL")
def a10(spark, folder):
    return Q.day_index(B.canonical_time(B.rename_columns(X.raw_bars(spark, folder)))).select("symbol", day().alias("d"), "rows", ep("min_ts").alias("min_ts"), ep("max_ts").alias("max_ts"), "dups")


@query("A11_symbol_index", SQL_RAW, sql="SELECT symbol, CAST(count(DISTINCT timestamp_utc // 86400000) AS BIGINT) AS days, CAST(count(*) AS BIGINT) AS rows, CAST(min(timestamp_utc) // 1000 AS BIGINT) AS min_ts, CAST(max(timestamp_utc) // 1000 AS BIGINT) AS max_ts, CAST(count(*) - count(DISTINCT timestamp_utc) AS BIGINT) AS dups FROM raw GROUP BY symbol")
def a11(spark, folder):
    days = Q.day_index(B.canonical_time(B.rename_columns(X.raw_bars(spark, folder))))
    return Q.symbol_index(days).select("symbol", "days", "rows", ep("min_ts").alias("min_ts"), ep("max_ts").alias("max_ts"), "dups")


@query("A12_window_catalog", WINDOWED, sql=f"SELECT CAST(window_days AS INT) AS window_days, CAST(count(DISTINCT symbol) AS BIGINT) AS symbols, CAST(count(*) AS BIGINT) AS rows, min({EP}) AS min_ts, max({EP}) AS max_ts, CAST(0 AS BIGINT) AS dups, CAST(0 AS BIGINT) AS null_rows FROM windowed GROUP BY window_days")
def a12(spark, folder):
    return Q.window_catalog(_windowed(spark, folder)).select("window_days", "symbols", "rows", ep("min_ts").alias("min_ts"), ep("max_ts").alias("max_ts"), "dups", "null_rows")


@query("A1_group_shares", SQL_BARS, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct FROM bars GROUP BY symbol")
def a1(spark, folder):
    return Q.shares(X.bars(spark, folder), ["symbol"])


@query("A16_null_share", DIRTY, sql="SELECT symbol, round(100 * avg(CAST(open IS NULL AS DOUBLE)), 6) AS open_null_pct, round(100 * avg(CAST(close IS NULL AS DOUBLE)), 6) AS close_null_pct FROM cast1 GROUP BY symbol")
def a16(spark, folder):
    return Q.null_share(_dirty(spark, folder).withColumns({c: B.to_number(c) for c in ("open", "close")}), ["symbol"], ["open", "close"])


GAPS = "SELECT symbol, CAST(count(*) FILTER (d > 3600) AS BIGINT) AS gaps, count(*) FILTER (d > 3600) / count(d) AS gap_rate, CAST(coalesce(sum(d // 3600 - 1) FILTER (d > 3600), 0) AS BIGINT) AS missing_bars, max(d) FILTER (d > 3600) AS max_gap, avg(CAST(d = 3600 AS DOUBLE)) AS exact_share FROM (SELECT symbol, {0} - lag({0}) OVER (PARTITION BY symbol{1} ORDER BY time_utc) AS d FROM bars) GROUP BY symbol"


@query("A17_gap_statistics", SQL_BARS, sql=GAPS.format(EP, ""))
def a17(spark, folder):
    return Q.gap_statistics(X.bars(spark, folder), 3600)


@query("A17_gap_statistics_within_day", SQL_BARS, sql=GAPS.format(EP, f", {DAY}"))
def a17_day(spark, folder):
    return Q.gap_statistics(X.bars(spark, folder), 3600, within_day=True)


@query("A18_expected_bars", SQL_BARS, sql=f"SELECT symbol, CAST(sum(n) AS BIGINT) AS n_bars, CAST(sum(room) AS BIGINT) AS expected, round(CAST(100.0 * sum(n) / sum(room) AS DOUBLE), 6) AS coverage_pct FROM (SELECT symbol, {DAY} AS d, count(*) AS n, (max({EP}) - min({EP})) // 3600 + 1 AS room FROM bars GROUP BY ALL) GROUP BY symbol")
def a18(spark, folder):
    return Q.expected_bars(X.bars(spark, folder), 3600)


@query("A19_spacing", SQL_BARS, sql=f"SELECT symbol, min(d) AS min_step, max(d) AS max_step FROM (SELECT symbol, {EP} - lag({EP}) OVER (PARTITION BY symbol ORDER BY time_utc) AS d FROM bars) GROUP BY symbol")
def a19(spark, folder):
    return Q.spacing(X.bars(spark, folder))


def _coverage(spark, folder):
    bars = X.bars(spark, folder).where("volume >= 2")
    present = bars.select("symbol", F.to_date("time_utc").alias("day"))
    ends = spark.sql("SELECT w AS window_days, explode(sequence(date_sub(DATE '2024-01-20', w - 1), DATE '2024-01-20')) AS day FROM (SELECT explode(array(2, 5, 10)) AS w)")
    return present, ends, X.bars(spark, folder).select("symbol")


COVER = SQL_BARS + f""",
present AS (SELECT DISTINCT symbol, CAST(time_utc AS DATE) AS d FROM bars WHERE volume >= 2),
wanted AS (SELECT w AS window_days, CAST(unnest(generate_series(DATE '2024-01-20' - CAST(w - 1 AS INT), DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT unnest([2, 5, 10]) AS w)),
missed AS (SELECT s.symbol, wanted.window_days, wanted.d FROM (SELECT DISTINCT symbol FROM bars) s, wanted WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.symbol = s.symbol AND p.d = wanted.d))"""  # fmt: skip


@query("J11_coverage_join", COVER, sql="SELECT symbol, CAST(window_days AS INT) AS window_days, CAST(count(*) AS BIGINT) AS missed FROM missed GROUP BY ALL")
def j11(spark, folder):
    return Q.coverage_misses(*_coverage(spark, folder)).groupBy("symbol", "window_days").agg(F.count(F.lit(1)).alias("missed"))


@query("A36_ready_windows", COVER, sql="SELECT s.symbol, CAST(max(w) FILTER (m.symbol IS NULL) AS INT) AS best_window, CAST(count(*) FILTER (m.symbol IS NULL) AS BIGINT) AS full_windows FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT unnest([2, 5, 10]) AS w) LEFT JOIN (SELECT DISTINCT symbol, window_days FROM missed) m ON m.symbol = s.symbol AND m.window_days = w GROUP BY s.symbol")
def a36(spark, folder):
    return Q.ready_windows(*_coverage(spark, folder))


@query("A35_readiness_gate", SYMBOLS, sql="SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (qa_struct_flag = 'OK_STRUCT') AS BIGINT) AS n_ok, count(*) FILTER (qa_struct_flag = 'OK_STRUCT') / count(*) AS ok_ratio, CAST(greatest(3, ceil(0.7 * count(*))) AS BIGINT) AS required, CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) FILTER (qa_struct_flag = 'OK_STRUCT') >= greatest(3, ceil(0.7 * count(*))) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM sym")
def a35(spark, folder):
    return Q.readiness_gate(Q.symbol_qa(_days(spark, folder)), F.col("qa_struct_flag") == "OK_STRUCT", least=3)


@query("A37_health_audit", QA_DAYS, sql="SELECT 'repeated bars' AS name, CAST(sum(dups) AS BIGINT) AS number, sum(dups) = 0 AS ok FROM days UNION ALL SELECT 'failed days', count(*) FILTER (status = 'FAIL'), count(*) FILTER (status = 'FAIL') = 0 FROM days UNION ALL SELECT 'empty days', count(*) FILTER (status = 'EMPTY'), count(*) FILTER (status = 'EMPTY') = 0 FROM days UNION ALL SELECT 'bars without volume', count(*) FILTER (volume < 1), count(*) FILTER (volume < 1) = 0 FROM bars")
def a37(spark, folder):
    bars, days = X.bars(spark, folder), _days(spark, folder)
    return Q.health_audit([("repeated bars", days, F.sum("dups")), ("failed days", days, F.count_if(F.col("status") == "FAIL")), ("empty days", days, F.count_if(F.col("status") == "EMPTY")), ("bars without volume", bars, F.count_if(F.col("volume") < 1))])


@query("J3_semi_join", SQL_BARS, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM bars WHERE symbol IN (SELECT symbol FROM bars WHERE close > 190) GROUP BY symbol")
def j3(spark, folder):
    bars = X.bars(spark, folder)
    return Q.filter_universe(bars, bars.where("close > 190")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("J4_anti_join", SQL_BARS, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars WHERE volume >= 6) GROUP BY symbol")
def j4(spark, folder):
    bars = X.bars(spark, folder)
    return Q.outside(bars, bars.where("volume >= 6")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("P10_minimum_size", SQL_BARS, sql=f"SELECT symbol, {DAY} AS d, CAST(count(*) AS BIGINT) AS n FROM bars GROUP BY ALL HAVING count(*) >= 20")
def p10(spark, folder):
    rows = Q.at_least(X.bars(spark, folder).withColumn("d", day(F.to_date("time_utc"))), ["symbol", "d"], 20)
    return rows.groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("n"))

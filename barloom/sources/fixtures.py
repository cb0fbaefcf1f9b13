"""Views over the driver's tables with the shapes of bars, trades, quotes and folds; each also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.joins import counted

EXPECTED_BARS = 24
BAR_SECONDS = 3600
LONG, SHORT = 24, 8
"""Rolling windows, in bars."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver's table; times without a zone are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.upper("event_type").alias("symbol"), F.col("ts").alias("time_utc"), (F.col("value") + 100).alias("price"), F.col("event_id").alias("seq"))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    from barloom.sources.bars import build_bars

    return build_bars(ticks(spark, folder), "1 hour")


def raw_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars under their raw names, time in epoch milliseconds, every 50th row twice (the second with close + 999)."""
    rows = bars(spark, folder)
    sizes = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("symbol", F.coalesce(F.sum("n").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(counted(before), "symbol").withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("symbol").orderBy("time_utc")))
    rows = rows.withColumn("ingest_seq", F.explode(F.when(F.col("rn") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows = rows.withColumn("close", F.col("close") + F.when(F.col("ingest_seq") == 2, 999.0).otherwise(0.0))
    return rows.select((F.unix_timestamp("time_utc") * 1000).alias("timestamp_utc"), "symbol", "open", "high", "low", "close", F.col("volume").alias("tick_volume"), F.col("spread").alias("spread_points"), "ingest_seq")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem")
    disc = F.round(F.col("l_discount") * 100).cast("int")
    days = F.col("l_linenumber") + 1
    gross, cost = (disc - 5) / F.lit(500.0), F.round(F.col("l_tax") * 100) / F.lit(10000.0)
    return x.select(
        F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 1, "LONG").otherwise("SHORT").alias("side"),
        F.concat(F.lit("F"), F.lpad((F.col("l_suppkey") % 10).cast("string"), 2, "0")).alias("fold_id"),
        F.when(F.col("l_linestatus") == "O", "OOS").otherwise("IS").alias("segment"), F.col("l_shipdate").alias("exit_time"),
        (F.col("l_shipdate") - F.make_dt_interval(days)).alias("entry_time"), (F.col("l_shipdate") - F.make_dt_interval(days, F.lit(1))).alias("signal_time"),
        (days * 24).alias("hold_bars"), gross.alias("gross_pnl"), cost.alias("cost"), (gross - cost).alias("net_pnl_base"), (gross - 2 * cost).alias("net_pnl_stress"),
        F.when(disc < 3, "SL").when(disc > 7, "TP").otherwise("TIME").alias("exit_reason"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), F.col("l_extendedprice").alias("k5"),
    )


TRADE_ORDER = ["exit_time", "k1", "k2", "k3", "k4", "k5"]


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    ask = F.col("p_retailprice") * (1 + F.col("p_size") / F.lit(1e5))
    return p.select(
        F.upper(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))).alias("symbol"), F.col("p_type").alias("path"), F.col("p_name").alias("description"),
        F.col("p_retailprice").alias("bid"), ask.alias("ask"), F.col("p_size").cast("double").alias("contract_size"), (F.col("p_partkey") % 7 != 0).alias("visible"), (F.col("p_partkey") % 5 - 1).cast("int").alias("trade_mode"),
    )


def folds(spark: SparkSession, folder: str) -> DataFrame:
    """In-sample 10 days, embargo 1, out-of-sample 4, step 4, from 2024-01-01 to 2024-01-31, for each symbol."""
    from barloom.operators.folds import rolling_folds

    symbols = ticks(spark, folder).select("symbol").distinct()
    bounds = symbols.select("symbol", F.to_timestamp(F.lit("2024-01-01")).alias("first"), F.to_timestamp(F.lit("2024-01-31")).alias("last"))
    return rolling_folds(bounds, is_days=10, embargo_days=1, oos_days=4, step_days=4)


SQL_TICKS = "ticks AS (SELECT upper(event_type) AS symbol, ts AS time_utc, value + 100 AS price, event_id AS seq FROM events)"
SQL_BARS = (
    SQL_TICKS
    + """,
bars AS (SELECT symbol, date_trunc('hour', time_utc) AS time_utc, first(price ORDER BY time_utc, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY time_utc, seq) AS close, CAST(count(*) AS DOUBLE) AS volume, round(max(price) - min(price), 6) / 10 AS spread FROM ticks GROUP BY ALL)"""
)
SQL_RAW = (
    SQL_BARS
    + """,
raw AS (SELECT CAST(epoch(time_utc) AS BIGINT) * 1000 AS timestamp_utc, symbol, open, high, low, close + CASE WHEN q = 2 THEN 999.0 ELSE 0.0 END AS close,
  volume AS tick_volume, spread AS spread_points, q AS ingest_seq
  FROM (SELECT *, unnest(CASE WHEN row_number() OVER (ORDER BY symbol, time_utc) % 50 = 0 THEN [1, 2] ELSE [1] END) AS q FROM bars))"""
)
SQL_TRADES = """trades AS (SELECT *, gross_pnl - cost AS net_pnl_base, gross_pnl - 2 * cost AS net_pnl_stress FROM (
  SELECT l_returnflag AS symbol, CASE WHEN l_linenumber % 2 = 1 THEN 'LONG' ELSE 'SHORT' END AS side, 'F' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 2, '0') AS fold_id,
  CASE WHEN l_linestatus = 'O' THEN 'OOS' ELSE 'IS' END AS segment, l_shipdate AS exit_time, l_shipdate - to_days(1 + l_linenumber) AS entry_time,
  l_shipdate - to_days(1 + l_linenumber) - INTERVAL 1 HOUR AS signal_time, 24 * (1 + l_linenumber) AS hold_bars,
  (CAST(round(l_discount * 100) AS INT) - 5) / 500.0::DOUBLE AS gross_pnl, round(l_tax * 100) / 10000.0::DOUBLE AS cost,
  CASE WHEN CAST(round(l_discount * 100) AS INT) < 3 THEN 'SL' WHEN CAST(round(l_discount * 100) AS INT) > 7 THEN 'TP' ELSE 'TIME' END AS exit_reason,
  l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5 FROM lineitem))"""
SQL_QUOTES = """quotes AS (SELECT upper(p_brand || '-' || CAST(p_partkey AS VARCHAR)) AS symbol, p_type AS path, p_name AS description, p_retailprice AS bid,
  p_retailprice * (1 + p_size / 1e5) AS ask, CAST(p_size AS DOUBLE) AS contract_size, p_partkey % 7 <> 0 AS visible, CAST(p_partkey % 5 - 1 AS INT) AS trade_mode FROM part)"""
SQL_FOLDS = """folds AS (SELECT symbol, printf('F%02d', k) AS fold_id, TIMESTAMP '2024-01-01' + to_days(CAST(4 * k AS INT)) AS is_start,
  TIMESTAMP '2024-01-01' + to_days(CAST(4 * k + 10 AS INT)) AS is_end, TIMESTAMP '2024-01-01' + to_days(CAST(4 * k + 11 AS INT)) AS oos_start,
  TIMESTAMP '2024-01-01' + to_days(CAST(4 * k + 15 AS INT)) AS oos_end
  FROM (SELECT DISTINCT symbol FROM ticks), (SELECT unnest(generate_series(0, 7)) AS k)
  WHERE TIMESTAMP '2024-01-01' + to_days(CAST(4 * k + 15 AS INT)) <= TIMESTAMP '2024-01-31')"""

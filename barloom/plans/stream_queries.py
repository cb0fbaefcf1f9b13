"""Streaming queries, each run over all that is there and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.features import returns
from barloom.operators.quality import daily_qa
from barloom.plans.bar_queries import DAY, EP, day, ep
from barloom.plans.registry import query
from barloom.scratch import scratch_folder
from barloom.sources import bars as B
from barloom.sources import fixtures as X
from barloom.sources.fixtures import EXPECTED_BARS, SQL_BARS, SQL_RAW
from barloom.streaming import ingest as I


def tick_stream(spark, folder) -> DataFrame:
    """The ticks as a stream of files in time order."""
    place = scratch_folder(spark, "ticks")
    X.ticks(spark, folder).repartitionByRange(4, "time_utc").write.parquet(place)
    return I.stream_of(spark, place)


def bar_stream(spark, folder, name: str = "bars") -> DataFrame:
    """The bars as a stream of files in time order."""
    place = scratch_folder(spark, name)
    X.bars(spark, folder).repartitionByRange(4, "time_utc").write.parquet(place)
    return I.stream_of(spark, place)


@query("R1_dedup_within_watermark", SQL_RAW, sql="SELECT symbol, CAST(timestamp_utc // 1000 AS BIGINT) AS t FROM raw GROUP BY ALL")
def r1(spark, folder):
    place = scratch_folder(spark, "raw")
    B.canonical_time(B.rename_columns(X.raw_bars(spark, folder))).write.parquet(place)
    return I.run_to_end(I.dedup_stream(I.stream_of(spark, place)), "dedup").select("symbol", ep("time_utc").alias("t"))


@query("R1_keep_last_ingest", SQL_RAW, sql="SELECT symbol, CAST(timestamp_utc // 1000 AS BIGINT) AS t, arg_max(close, ingest_seq) AS close FROM raw GROUP BY ALL")
def r1_last(spark, folder):
    source, store = scratch_folder(spark, "raw"), scratch_folder(spark, "store")
    rows = B.canonical_time(B.rename_columns(X.raw_bars(spark, folder)))
    rows.where("ingest_seq = 1").coalesce(1).write.parquet(source)
    rows.where("ingest_seq = 2").coalesce(1).write.mode("append").parquet(source)
    I.each_batch(I.stream_of(spark, source, 1), "ingest", I.keep_last(store))
    return B.read_store(spark, store).select("symbol", ep("time_utc").alias("t"), "close")


@query("R2_reopened_days", SQL_BARS, sql=f"SELECT symbol, {DAY} AS d, CAST(count(*) AS BIGINT) AS n_bars FROM bars WHERE day(time_utc) IN (5, 6, 20) GROUP BY ALL")
def r2(spark, folder):
    store, source, out = scratch_folder(spark, "store"), scratch_folder(spark, "days"), scratch_folder(spark, "qa")
    bars = X.bars(spark, folder)
    B.write_bars(bars, store)
    bars.select("symbol", F.to_date("time_utc").alias("day")).where(F.day("day").isin(5, 6, 20)).distinct().write.parquet(source)
    I.each_batch(I.stream_of(spark, source), "reopen", I.reopen_days(store, out, lambda rows: daily_qa(rows, EXPECTED_BARS)))
    return spark.read.parquet(out).select("symbol", day().alias("d"), "n_bars")


CLOSED = "epoch(time_utc)::BIGINT + {0} <= (SELECT floor(epoch(max(ts))) - {1} FROM events)"


@query("R3_bars_from_ticks", SQL_BARS, sql=f"SELECT symbol, {EP} AS t, open, high, low, close, volume FROM bars WHERE {CLOSED.format(3600, 3600)}")
def r3(spark, folder):
    rows = I.run_to_end(I.bars_from_ticks(tick_stream(spark, folder), "1 hour", "1 hour"), "bars")
    return rows.select("symbol", ep("time_utc").alias("t"), "open", "high", "low", "close", "volume")


@query("R8_only_closed_bars", SQL_BARS, sql=f"SELECT CAST(count(*) AS BIGINT) AS n, max({EP}) AS last FROM (SELECT DISTINCT time_bucket(INTERVAL 6 HOUR, time_utc) AS time_utc, symbol FROM bars) WHERE {CLOSED.format(6 * 3600, 0)}")
def r8(spark, folder):
    rows = I.run_to_end(I.bars_from_ticks(tick_stream(spark, folder), "6 hours", "0 seconds"), "bars")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(ep("time_utc")).alias("last"))


LAST_BAR = "(SELECT max(epoch(time_utc))::BIGINT FROM bars)"


@query("R4_daily_qa_stream", SQL_BARS, sql=f"SELECT symbol, {DAY} AS d, CAST(count(*) AS BIGINT) AS n_bars, round(100.0 * count(*) / 24, 6) AS grid_pct, sum(volume) AS volume FROM bars GROUP BY symbol, {DAY} HAVING {DAY} + 86400 <= {LAST_BAR} - 86400")
def r4(spark, folder):
    rows = I.run_to_end(I.daily_qa_stream(bar_stream(spark, folder), EXPECTED_BARS), "qa")
    return rows.select("symbol", day().alias("d"), "n_bars", "grid_pct", "volume")


@query("R5_trailing_windows_stream", SQL_BARS, sql=f"SELECT symbol, e AS window_end, CAST(count(*) AS BIGINT) AS rows, sum(volume) AS volume FROM (SELECT *, unnest(generate_series({DAY} + 86400, {DAY} + 5 * 86400, 86400)) AS e FROM bars) WHERE e <= {LAST_BAR} - 86400 GROUP BY symbol, e")
def r5(spark, folder):
    rows = I.run_to_end(I.trailing_stream(bar_stream(spark, folder), "5 days", "1 day"), "windows")
    return rows.select("symbol", ep("window_end").alias("window_end"), "rows", "volume")


@query("R6_confirmation_state", SQL_BARS, sql=f"SELECT symbol, {EP} AS t FROM (SELECT *, row_number() OVER (PARTITION BY symbol, run, g ORDER BY time_utc) AS k FROM (SELECT *, sum(CAST(NOT g AS INT)) OVER (PARTITION BY symbol ORDER BY time_utc) AS run FROM (SELECT *, coalesce(close > lag(close) OVER (PARTITION BY symbol ORDER BY time_utc), false) AS g FROM bars))) WHERE g AND k % 2 = 0 AND {EP} <= {LAST_BAR} - 86400")
def r6(spark, folder):
    place = scratch_folder(spark, "gates")
    rows = returns(X.bars(spark, folder)).select("symbol", "time_utc", F.coalesce(F.col("close") > F.col("prev_close"), F.lit(False)).alias("gate"))
    rows.repartitionByRange(4, "time_utc").write.parquet(place)
    return I.run_to_end(I.confirmations(I.stream_of(spark, place), 2, 0), "streaks").select("symbol", ep("time_utc").alias("t"))


@query("R7_sessions", X.SQL_TICKS, sql="SELECT symbol, CAST(min(epoch(time_utc)) AS BIGINT) AS start, CAST(max(epoch(time_utc)) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY time_utc, seq) AS s FROM (SELECT *, CASE WHEN time_utc - lag(time_utc) OVER (PARTITION BY symbol ORDER BY time_utc, seq) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ticks)) GROUP BY symbol, s".replace("CAST(min(epoch(time_utc)) AS BIGINT)", "CAST(floor(min(epoch(time_utc))) AS BIGINT)").replace("CAST(max(epoch(time_utc)) AS BIGINT)", "CAST(floor(max(epoch(time_utc))) AS BIGINT)"))
def r7(spark, folder):
    return I.sessions(X.ticks(spark, folder), "30 minutes").select("symbol", ep("start").alias("start"), ep("last").alias("last"), "n")


@query("R7_sessions_stream", X.SQL_TICKS, sql="SELECT symbol, CAST(floor(min(epoch(time_utc))) AS BIGINT) AS start, CAST(floor(max(epoch(time_utc))) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY time_utc, seq) AS s FROM (SELECT *, CASE WHEN time_utc - lag(time_utc) OVER (PARTITION BY symbol ORDER BY time_utc, seq) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ticks)) GROUP BY symbol, s HAVING max(time_utc) + INTERVAL 30 MINUTE <= (SELECT max(time_utc) FROM ticks) - INTERVAL 1 HOUR")
def r7_stream(spark, folder):
    return I.run_to_end(I.sessions(tick_stream(spark, folder), "30 minutes", "1 hour"), "sessions").select("symbol", ep("start").alias("start"), ep("last").alias("last"), "n")

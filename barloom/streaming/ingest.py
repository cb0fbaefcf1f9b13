"""Structured Streaming forms of ingest, bars, quality control, windows, streaks and sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.scratch import scratch_folder
from barloom.sources.bars import dedup, last_manifest, read_store, write_bars


def stream_of(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; times without a zone are read as UTC."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to a shared folder and read back."""
    spark, place = stream.sparkSession, scratch_folder(stream.sparkSession, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def each_batch(stream: DataFrame, name: str, work: Callable[[DataFrame, int], None]) -> None:
    place = scratch_folder(stream.sparkSession, name)
    stream.writeStream.foreachBatch(work).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def dedup_stream(bars: DataFrame, delay: str = "3 days") -> DataFrame:
    """Bars once for each key while the key's copies arrive within the delay; the first one stays."""
    return bars.withWatermark("time_utc", delay).dropDuplicatesWithinWatermark(["symbol", "time_utc"])


def keep_last(path: str, order: tuple[str, ...] = ("ingest_seq",)) -> Callable[[DataFrame, int], None]:
    """For each batch, the days that it touches are written again, of equal keys the last row staying."""

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = batch.select("symbol", F.to_date("time_utc").alias("day")).distinct()
        rows = batch
        if last_manifest(spark, path) is not None:
            stored = read_store(spark, path).select(*batch.columns).withColumn("day", F.to_date("time_utc"))
            rows = stored.join(days.hint("shuffle_merge"), ["symbol", "day"], "left_semi").select(*batch.columns).unionByName(batch)
        write_bars(dedup(rows, order=order), path, days)

    return work


def reopen_days(path: str, qa_path: str, qa: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For each batch of (symbol, day) to be done again, their quality rows are computed from the store and appended with the batch's number."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days = batch.select("symbol", "day").distinct()
        rows = read_store(spark, path).withColumn("day", F.to_date("time_utc")).join(days.hint("shuffle_merge"), ["symbol", "day"], "left_semi").drop("day", "year", "month")
        qa(rows).withColumn("batch", F.lit(number)).write.mode("append").parquet(qa_path)

    return work


def bars_from_ticks(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling bars; in append mode only those that are closed come out, never the one still forming."""
    at = F.struct("time_utc", "seq")
    rows = ticks.withWatermark("time_utc", delay).groupBy(F.window("time_utc", width).alias("w"), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return rows.select("symbol", F.col("w.start").alias("time_utc"), "open", "high", "low", "close", "volume")


def daily_qa_stream(bars: DataFrame, expected_bars: int, delay: str = "1 day") -> DataFrame:
    rows = bars.withWatermark("time_utc", delay).groupBy(F.window("time_utc", "1 day").alias("w"), "symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("low") > F.col("high")).alias("low_gt_high"), F.sum("volume").alias("volume"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return rows.select("symbol", F.to_date("w.start").alias("day"), "n_bars", F.round(100.0 * F.col("n_bars") / expected_bars, 6).alias("grid_pct"), "low_gt_high", "volume", "low", "high")


def trailing_stream(bars: DataFrame, size: str, step: str, delay: str = "1 day") -> DataFrame:
    """Sliding windows of that size, one for each step."""
    rows = bars.withWatermark("time_utc", delay).groupBy(F.window("time_utc", size, step).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("volume").alias("volume"))
    return rows.select("symbol", F.col("w.end").alias("window_end"), "rows", "low", "high", "volume")


def sessions(ticks: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions end with a gap; batch or streaming (with a delay)."""
    rows = ticks.withWatermark("time_utc", delay) if delay else ticks
    out = rows.groupBy(F.session_window("time_utc", gap).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.max("time_utc").alias("last"))
    return out.select("symbol", F.col("w.start").alias("start"), "last", "n", "low", "high")


STREAKS = "symbol string, time_utc timestamp, streak long"


def confirmations(bars: DataFrame, k: int, cooldown: int, delay: str = "1 day", idle: str = "30 days") -> DataFrame:
    """bars (symbol, time_utc, gate): a row where the gate has held k bars in a row, after which `cooldown` bars are passed over.

    Bars wait in the state until the watermark has passed them, so those that come out of order
    within the delay are taken in order; later ones are dropped. State for each symbol: run length,
    bars left to pass over, the last bar taken, and the bars that wait. A symbol without bars for
    the idle time loses its state.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, rest, last, times, gates = state.get if state.exists else (0, 0, -(2**62), [], [])
        waiting = list(zip(times, gates, strict=True))
        if not state.hasTimedOut:
            for rows in frames:
                micros = rows["time_utc"].astype("datetime64[us]").astype("int64")
                waiting += [(int(t), bool(g)) for t, g in zip(micros, rows["gate"], strict=True) if t > last]
        waiting.sort()
        water = state.getCurrentWatermarkMs()
        out, at = [], 0
        while at < len(waiting) and waiting[at][0] <= water * 1000:
            last, gate = waiting[at]
            at += 1
            run = run + 1 if gate else 0
            if rest > 0:
                rest -= 1
            elif run >= k:
                out.append((key[0], last, run))
                run, rest = 0, cooldown
        waiting = waiting[at:]
        if state.hasTimedOut and not waiting and last // 1000 + idle_ms <= water:
            state.remove()
        else:
            state.update((run, rest, last, [t for t, _ in waiting], [g for _, g in waiting]))
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 if waiting else last // 1000 + idle_ms, water + 1))
        found = pd.DataFrame(out, columns=["symbol", "time_utc", "streak"])
        yield found.assign(time_utc=pd.to_datetime(found["time_utc"].astype("int64"), unit="us"))

    rows = bars.select("symbol", "time_utc", "gate").withWatermark("time_utc", delay)
    return rows.groupBy("symbol").applyInPandasWithState(step, STREAKS, "run long, rest long, last long, times array<long>, gates array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)

"""Quality control of bars: days, symbols, data-quality score, universe, indices, readiness and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import counted

from barloom.functions.ranks import linear

MAX_RETURN, MAX_ZERO_SHARE = 0.5, 0.8
"""A day's price is bad from this absolute return or this share of zero returns on."""


def daily_qa(bars: DataFrame, expected_bars: int, min_grid_pct: float = 90.0) -> DataFrame:
    """One row a symbol and day: counts, grid share, structural flags, spread quantiles, price sanity, status and notes."""
    rows = bars.withColumns({"day": F.to_date("time_utc"), "prev": F.lag("close").over(Window.partitionBy("symbol", F.to_date("time_utc")).orderBy("time_utc"))})
    rows = rows.withColumns({"ret": F.try_divide("close", "prev") - 1, "bps": F.try_divide("spread", "close") * 10000})
    prices = ("open", "high", "low", "close")
    any_null = F.greatest(*[F.col(c).isNull().cast("int") for c in prices])
    any_nan = F.greatest(*[F.coalesce(F.isnan(c), F.lit(False)).cast("int") for c in prices])
    out = rows.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n_bars"), F.countDistinct("time_utc").alias("n_unique_ts"), (F.max(any_null) == 1).alias("has_null"), (F.max(any_nan) == 1).alias("has_nan"),
        F.coalesce(F.bool_or(F.col("low") > F.col("high")), F.lit(False)).alias("low_gt_high"), linear("spread", 0.5).alias("spread_p50"), linear("bps", 0.5).alias("spread_bps_p50"), linear("bps", 0.9).alias("spread_bps_p90"),
        F.coalesce(F.avg((F.col("ret") == 0).cast("double")), F.lit(0.0)).alias("zero_share"), F.max(F.abs("ret")).alias("max_ret"),
    )
    out = out.withColumns({"dups": F.col("n_bars") - F.col("n_unique_ts"), "grid_pct": F.round(100.0 * F.col("n_unique_ts") / expected_bars, 6)})
    bad_price = (F.coalesce(F.col("max_ret"), F.lit(0.0)) >= MAX_RETURN) | (F.col("zero_share") >= MAX_ZERO_SHARE)
    out = out.withColumn("price_flag", F.when(F.col("n_bars") < 2, "EMPTY").when(bad_price, "BAD").otherwise("OK"))
    broken = F.col("has_null") | F.col("has_nan") | F.col("low_gt_high") | (F.col("dups") > 0)
    out = out.withColumn("status", F.when(F.col("n_bars") < 2, "EMPTY").when(broken, "FAIL").when((F.col("grid_pct") < min_grid_pct) | (F.col("price_flag") == "BAD"), "WARN").otherwise("OK"))
    note = lambda test, text: F.when(test, F.lit(text))
    notes = F.concat_ws(",", note(F.col("has_null"), "NULL_OHLC"), note(F.col("has_nan"), "NAN_OHLC"), note(F.col("low_gt_high"), "LOW_GT_HIGH"), note(F.col("dups") > 0, "DUPS"), note(F.col("grid_pct") < min_grid_pct, "LOW_GRID"), note(bad_price, "PRICE"))
    return out.withColumn("notes", notes)


def symbol_qa(days: DataFrame) -> DataFrame:
    """Day QA rolled up by symbol, with session type and the three flags."""
    count = lambda test: F.count_if(test)
    out = days.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"), count(F.col("status") == "OK").alias("ok_days"), count(F.col("status") == "WARN").alias("warn_days"), count(F.col("status") == "FAIL").alias("fail_days"),
        count(F.col("status") == "EMPTY").alias("empty_days"), count(F.col("price_flag") == "BAD").alias("bad_price_days"), F.avg("n_bars").alias("mean_bars"), F.median("n_bars").alias("median_bars"),
        F.avg("grid_pct").alias("mean_grid"), F.median("grid_pct").alias("median_grid"), F.sum("dups").alias("dups"),
    )
    out = out.withColumns({"fail_ratio": F.col("fail_days") / F.col("n_days"), "ok_ratio": F.col("ok_days") / F.col("n_days"), "bad_price_ratio": F.col("bad_price_days") / F.col("n_days")})
    out = out.withColumn("session_type", F.when(F.col("median_grid") >= 90, "24H").when(F.col("median_grid") >= 25, "DIURNA").otherwise("ILLQ"))
    out = out.withColumn("qa_struct_flag", F.when(F.col("fail_ratio") > 0.05, "BAD_STRUCT").when(F.col("fail_ratio") > 0, "WARN_STRUCT").otherwise("OK_STRUCT"))
    by_grid = lambda good, fair: F.when(F.col("mean_grid") >= good, "OK").when(F.col("mean_grid") >= fair, "WARN").otherwise("BAD")
    out = out.withColumn("qa_operativa_flag", F.when(F.col("session_type") == "24H", by_grid(95, 85)).when(F.col("session_type") == "DIURNA", by_grid(60, 30)).otherwise("BAD"))
    return out.withColumn("qa_price_flag", F.when(F.col("bad_price_ratio") > 0.10, "BAD").when(F.col("bad_price_ratio") > 0.02, "WARN").otherwise("OK"))


def coverage_gate(days: DataFrame, min_bars: float, min_grid: float) -> DataFrame:
    """One row: global coverage, and whether it fails (mean and median both below the floor)."""
    out = days.agg(F.avg("n_bars").alias("mean_bars"), F.median("n_bars").alias("median_bars"), F.avg("grid_pct").alias("mean_grid"), F.median("grid_pct").alias("median_grid"))
    low = ((F.col("mean_bars") < min_bars) & (F.col("median_bars") < min_bars)) | ((F.col("mean_grid") < min_grid) & (F.col("median_grid") < min_grid))
    return out.withColumn("hard_fail", low)


def require_coverage(days: DataFrame, min_bars: float, min_grid: float) -> None:
    row = coverage_gate(days, min_bars, min_grid).first()
    if row.hard_fail:
        raise ValueError(f"coverage too low: {row.asDict()}")


def data_quality(bars: DataFrame, expected_bars: int, offset_hours: int = 0, gap_share: float = 0.5) -> DataFrame:
    """Score of each symbol from coverage (0.6), days present (0.3) and days without a large gap (0.1)."""
    local = F.to_date(F.col("time_utc") + F.make_dt_interval(F.lit(0), F.lit(offset_hours)))
    days = bars.groupBy("symbol", local.alias("day")).agg(F.count(F.lit(1)).alias("candles"))
    out = days.groupBy("symbol").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days_present"), F.sum("candles").alias("candles"), F.count_if(F.col("candles") < gap_share * expected_bars).alias("gap_days")
    )
    out = out.withColumn("days_span", F.datediff("last_day", "first_day") + 1)
    out = out.withColumn("coverage_pct", F.least(F.lit(100.0), 100.0 * F.col("candles") / (F.col("days_span") * expected_bars)))
    out = out.withColumns({"missing_pct": F.greatest(F.lit(0.0), 100.0 - F.col("coverage_pct")), "days_pct": 100.0 * F.col("days_present") / F.col("days_span"), "gap_pct": 100.0 * F.col("gap_days") / F.col("days_present")})
    score = 0.6 * F.col("coverage_pct") + 0.3 * F.col("days_pct") + 0.1 * (100.0 - F.col("gap_pct"))
    out = out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2))
    return out.withColumn("dq_flag", F.when(F.col("score") >= 80, "OK").when(F.col("score") >= 60, "WARNING").otherwise("BAD"))


def universe(symbols: DataFrame, scores: DataFrame, eligible: DataFrame, min_score: float = 60.0) -> DataFrame:
    """Symbols with the reasons that keep them, IN if all do."""
    rows = eligible.select("symbol").distinct().withColumn("keep_by_cost", F.lit(True))
    rows = symbols.join(scores.select("symbol", "score", "dq_flag"), "symbol", "left").join(rows, "symbol", "left")
    rows = rows.withColumns({
        "keep_by_cost": F.coalesce("keep_by_cost", F.lit(False)), "keep_by_qa": F.col("qa_operativa_flag").isin("OK", "WARN"), "keep_by_struct": F.col("qa_struct_flag") != "BAD_STRUCT",
        "keep_by_price": F.col("qa_price_flag") != "BAD", "keep_by_dq": F.coalesce(F.col("dq_flag").isin("OK", "WARNING") & (F.col("score") >= min_score), F.lit(False)),
    })
    every = F.col("keep_by_cost") & F.col("keep_by_qa") & F.col("keep_by_struct") & F.col("keep_by_price") & F.col("keep_by_dq")
    return rows.withColumn("universe_flag", F.when(every, "IN").otherwise("OUT"))


def catalog(bars: DataFrame) -> DataFrame:
    """What is stored of each symbol: bars, days, first and last time, months spanned."""
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.countDistinct(F.to_date("time_utc")).alias("n_days"), F.min("time_utc").alias("first_ts"), F.max("time_utc").alias("last_ts"))
    return out.withColumn("months_span", (F.year("last_ts") - F.year("first_ts")) * 12 + F.month("last_ts") - F.month("first_ts") + 1)


def file_manifest(stored: DataFrame) -> DataFrame:
    """One row a file: symbol, day, size, rows, first and last time, from the file columns of the scan."""
    return stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.max("_metadata.file_size").alias("size"), F.min("symbol").alias("symbol"), F.min(F.to_date("time_utc")).alias("day"), F.count(F.lit(1)).alias("rows"), F.min("time_utc").alias("min_ts"), F.max("time_utc").alias("max_ts")
    )


def day_index(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.to_date("time_utc").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("time_utc").alias("min_ts"), F.max("time_utc").alias("max_ts"), (F.count(F.lit(1)) - F.countDistinct("time_utc")).alias("dups")
    )


def symbol_index(days: DataFrame) -> DataFrame:
    return days.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("dups").alias("dups"))


def window_catalog(windowed: DataFrame) -> DataFrame:
    """Per trailing window: symbols, rows, time range, repeats over the union, rows without prices."""
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in ("open", "high", "low", "close")]) == 1
    return windowed.groupBy("window_days").agg(
        F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("rows"), F.min("time_utc").alias("min_ts"), F.max("time_utc").alias("max_ts"),
        (F.count(F.lit(1)) - F.countDistinct(F.struct("symbol", "time_utc"))).alias("dups"), F.count_if(missing).alias("null_rows"),
    )


def null_share(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.round(100 * F.avg(F.col(c).isNull().cast("double")), 6).alias(f"{c}_null_pct") for c in columns])


def gap_statistics(bars: DataFrame, step: int, within_day: bool = False) -> DataFrame:
    """Gaps wider than a step: number, rate, bars missing, widest; and the share of exact steps."""
    keys = ["symbol", F.to_date("time_utc")] if within_day else ["symbol"]
    rows = bars.withColumn("d", F.unix_timestamp("time_utc") - F.unix_timestamp(F.lag("time_utc").over(Window.partitionBy(*keys).orderBy("time_utc"))))
    wide = F.col("d") > step
    return rows.groupBy("symbol").agg(
        F.count_if(wide).alias("gaps"), F.try_divide(F.count_if(wide), F.count("d")).alias("gap_rate"), F.coalesce(F.sum(F.when(wide, F.expr(f"d div {step} - 1"))), F.lit(0)).alias("missing_bars"),
        F.max(F.when(wide, F.col("d"))).alias("max_gap"), F.avg((F.col("d") == step).cast("double")).alias("exact_share"),
    )


def expected_bars(bars: DataFrame, step: int) -> DataFrame:
    """Bars that each symbol's own days allow, and how many of them are there."""
    days = bars.groupBy("symbol", F.to_date("time_utc").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("time_utc").alias("a"), F.max("time_utc").alias("b"))
    days = days.withColumn("room", F.expr(f"(unix_timestamp(b) - unix_timestamp(a)) div {step} + 1"))
    return days.groupBy("symbol").agg(F.sum("n").alias("n_bars"), F.sum("room").alias("expected"), F.round(100.0 * F.sum("n") / F.sum("room"), 6).alias("coverage_pct"))


def spacing(bars: DataFrame) -> DataFrame:
    d = F.unix_timestamp("time_utc") - F.unix_timestamp(F.lag("time_utc").over(Window.partitionBy("symbol").orderBy("time_utc")))
    return bars.withColumn("d", d).groupBy("symbol").agg(F.min("d").alias("min_step"), F.max("d").alias("max_step"))


def coverage_misses(present: DataFrame, windows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Days that a window asks of a symbol and that are missing. windows: window_days, day."""
    # Every window is asked of every symbol: symbols are keyed by the few windows that there are.
    spans = windows.groupBy("window_days").agg(F.collect_list("day").alias("days")).agg(F.collect_list(F.struct("window_days", "days")).alias("w"))
    wanted = symbols.select("symbol").distinct().join(F.broadcast(spans)).select("symbol", F.explode("w").alias("w")).select("w.window_days", F.explode("w.days").alias("day"), "symbol")
    return wanted.join(present.select("symbol", "day").distinct().hint("shuffle_merge"), ["symbol", "day"], "left_anti")


def ready_windows(present: DataFrame, windows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each symbol with its full windows and the best (longest) of them.

    A window is full where a symbol has as many of its days as it asks for, so only days that are there meet the windows; none is made up.
    """
    asked = windows.select("window_days", "day").distinct()
    sizes = asked.groupBy("window_days").agg(F.count("day").alias("_asked"))
    own = symbols.select("symbol").distinct()
    days = present.select("symbol", "day").distinct().join(own.hint("shuffle_merge"), "symbol", "left_semi")
    held = days.join(counted(asked), "day").groupBy("symbol", "window_days").agg(F.count(F.lit(1)).alias("_held"))
    whole = held.join(counted(sizes), "window_days").where("_held = _asked").groupBy("symbol").agg(F.max("window_days").alias("best_window"), F.count(F.lit(1)).alias("full_windows"))
    return own.join(whole.hint("shuffle_merge"), "symbol", "left").withColumn("full_windows", F.coalesce("full_windows", F.lit(0)))


def readiness_gate(rows: DataFrame, ok: Column, base: Column | None = None, least: int = 50, share: float = 0.7) -> DataFrame:
    """One row: how many are fine, how many are required, PASS, FAIL or EMPTY."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"))
    out = out.withColumns({"ok_ratio": F.try_divide("n_ok", "n"), "required": F.greatest(F.lit(least), F.ceil(share * F.col("n"))).cast("long")})
    return out.withColumn("verdict", F.when(F.col("n") == 0, "EMPTY").when(F.col("n_ok") >= F.col("required"), "PASS").otherwise("FAIL"))


def health_audit(checks: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """One row a check (name, number, ok): each an aggregate over one table that should be zero."""
    out = None
    for name, rows, number in checks:
        one = rows.agg(F.coalesce(number, F.lit(0)).cast("long").alias("number")).select(F.lit(name).alias("name"), "number", (F.col("number") == 0).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def filter_universe(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    return rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def outside(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    return rows.join(symbols.select("symbol").distinct(), "symbol", "left_anti")


def at_least(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the groups that have n rows or more."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")


def shares(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group counts with their share of all rows, in percent."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))

"""Barrier exits by an index of blocks, against a loop over bars."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import trades

START = dt.datetime(2024, 1, 1)


def by_hand(bars, entry, time_stop, min_hold, off_bars, weekdays_only):
    symbol, i, side, price, atr, sl, tp, trail = entry
    s = 1 if side == "LONG" else -1
    best, on = price, i
    for j in range(i + 1, min(i + time_stop, len(bars) - 1) + 1):
        _, high, low, close, gate_long, gate_short, weekend = bars[j]
        best = max(best, high) if s == 1 else min(best, low)
        on = j if (gate_long if s == 1 else gate_short) else on
        hit = lambda level: low <= level if s == 1 else high >= level
        if hit(price - s * sl * atr):
            return j, "SL", price - s * sl * atr
        if trail and hit(best - s * trail * atr):
            return j, "TRAIL", best - s * trail * atr
        if high >= price + tp * atr if s == 1 else low <= price - tp * atr:
            return j, "TP", price + s * tp * atr
        for reason, test in (("TIME", j - i >= time_stop), ("REGIME_OFF", j - i >= min_hold and j - on >= off_bars), ("WEEKEND", weekend and weekdays_only)):
            if test:
                return j, reason, close
    return None


@pytest.mark.parametrize(("time_stop", "min_hold", "off_bars", "weekdays_only"), [(40, 3, 5, False), (7, 1, 30, True), (200, 150, 4, False)])
def test_exits_are_the_loop(spark, time_stop, min_hold, off_bars, weekdays_only):
    rng = np.random.default_rng(time_stop)
    bars, entries, want = {}, [], {}
    for symbol, n in (("a", 300), ("b", 30)):
        close = 100 + np.round(np.cumsum(rng.normal(0, 0.3, n)), 2)
        spread = np.round(np.abs(rng.normal(0, 0.2, (2, n))), 2)
        gates, weekend = rng.random((2, n)) < 0.15, rng.random(n) < 0.02
        bars[symbol] = [(k, float(close[k] + spread[0][k]), float(close[k] - spread[1][k]), float(close[k]), bool(gates[0][k]), bool(gates[1][k]), bool(weekend[k])) for k in range(n)]
        for i in range(0, n - 2, 3):
            for combo, (sl, tp, trail) in enumerate(((4.0, 6.0, 0.0), (30.0, 5.0, None), (50.0, 60.0, 2.0), (1.5, 9.0, 3.0))):
                side = "LONG" if rng.random() < 0.5 else "SHORT"
                entry = (symbol, i, side, float(close[i]), 0.5, sl, tp, trail)
                entries.append((*entry, combo, START + dt.timedelta(hours=i)))
                want[symbol, i, combo] = by_hand(bars[symbol], entry, time_stop, min_hold, off_bars, weekdays_only)
    rows = [(symbol, START + dt.timedelta(hours=k), *rest, k) for symbol, own in bars.items() for k, *rest in own]
    table = spark.createDataFrame(rows, "symbol string, time_utc timestamp, high double, low double, close double, gate_long boolean, gate_short boolean, weekend boolean, idx int")
    asked = spark.createDataFrame(entries, "symbol string, i int, side string, entry_price double, atr double, sl double, tp double, trail double, combo int, signal_time timestamp")
    out = trades.label_exits(asked, table, time_stop, min_hold, off_bars, weekdays_only, ("combo", "sl", "tp", "trail")).collect()
    got = {(r.symbol, r.i, r.combo): (r.exit_idx, r.exit_reason, r.exit_price) for r in out}
    assert got == {k: v for k, v in want.items() if v} and len(out) == len(got)
    assert len({v[1] for v in got.values()}) >= 4
    assert all(r.hold_bars == r.exit_idx - r.i and r.exit_time == START + dt.timedelta(hours=r.exit_idx) for r in out)


def test_one_row_of_blocks_for_an_entry(spark):
    """What an entry meets does not grow with the time stop."""
    rows = [("a", START + dt.timedelta(hours=k), 101.0, 99.0, 100.0, True, True, False, k) for k in range(600)]
    table = spark.createDataFrame(rows, "symbol string, time_utc timestamp, high double, low double, close double, gate_long boolean, gate_short boolean, weekend boolean, idx int")
    for time_stop in (16, 400):
        block = max(2, round(time_stop**0.5))
        held, spans = trades._block_index(table, block, -(-time_stop // block) + 1)
        assert held.groupBy("symbol", "block").count().where("count > 1").count() == 0
        assert spans.groupBy("symbol", "span").count().where("count > 1").count() == 0
    assert trades.label_exits(table.limit(0).select("symbol", F.col("idx").alias("i"), F.lit("LONG").alias("side"), F.col("close").alias("entry_price"), F.col("close").alias("atr"), F.lit(1.0).alias("sl"), F.lit(1.0).alias("tp"), F.lit(0.0).alias("trail"), F.col("time_utc").alias("signal_time")), table, 16, 1, 1).count() == 0

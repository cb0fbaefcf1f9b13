"""Golden numbers, directions and edge cases of single operators."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import costs, times
from barloom.operators import account, features, metrics, quality, resample, stats, trades
from barloom.sources import bars as B


def series(spark, n=40, symbol="X", start=datetime(2024, 1, 1)):
    rows = [(symbol, start + timedelta(hours=k), 100.0 + k, 101.0 + k, 99.0 + k, 100.5 + k, 1.0, 0.1) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, time_utc timestamp, open double, high double, low double, close double, volume double, spread double")


def test_round_trip_is_one_thousandth(spark):
    row = spark.range(1).select(costs.round_trip(F.lit(4.0), F.lit(2.0), F.lit(1.0)).alias("x"), costs.stressed(F.lit(4.0), F.lit(2.0), F.lit(1.0)).alias("y")).first()
    assert row.x == pytest.approx(0.001) and row.y > row.x


def test_dedup_keeps_last_or_first(spark):
    rows = series(spark, 10).withColumn("ingest_seq", F.lit(1))
    again = rows.limit(3).withColumn("close", F.col("close") + 999).withColumn("ingest_seq", F.lit(2))
    both = rows.unionByName(again)
    assert B.dedup(both).count() == 10 and B.dedup(both).where("close > 900").count() == 3
    assert B.dedup(both, keep="first").where("close > 900").count() == 0


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="high"):
        B.require_columns(spark.range(1), ["id", "high"])
    with pytest.raises(ValueError, match="close"):
        B.resolve_columns(spark.createDataFrame([("X", 1, 1.0, 1.0, 1.0)], "symbol string, time long, o double, h double, l double"))


def test_coverage_gate_raises(spark):
    days = quality.daily_qa(series(spark, 3), 24)
    with pytest.raises(ValueError, match="coverage"):
        quality.require_coverage(days, 10, 90)


def test_rolling_features_are_null_until_full(spark):
    rows = features.all_features(series(spark, 30), 24, 8).orderBy("time_utc").collect()
    assert [r.atr is None for r in rows[:9]] == [True] * 7 + [False] * 2
    assert rows[23].er is None and rows[24].er == pytest.approx(1.0)


def test_value_at_risk_index(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(100)], "k string, v double")
    row = metrics.value_at_risk(rows, ["k"], "v").first()
    assert row["var"] == 5.0 and row["cvar"] <= row["var"]


def test_compound_equity_handles_total_loss(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -2.0), ("a", 3, -1.0), ("a", 4, 0.3)], "k string, i int, r double")
    got = [r.equity for r in metrics.compound_equity(rows, ["k"], ["i"], "r").orderBy("i").collect()]
    assert got == pytest.approx([1.5, -1.5, 0.0, 0.0])


def test_weekday_is_iso(spark):
    row = spark.sql("select timestamp '2024-01-06 10:00:00' as t").select(times.iso_weekday(F.col("t")).alias("d"), times.is_weekend(F.col("t")).alias("w")).first()
    assert row.d == 6 and row.w


def replay_loop(rows, daily, total, target, days):
    equity, log, taken, seen, bust, won = 0.0, {}, 0, set(), False, False
    for d, p in rows:
        if log.get(d, 0.0) <= -daily:
            continue
        equity += p
        log[d] = log.get(d, 0.0) + p
        taken += 1
        seen.add(d)
        if equity <= -total:
            bust = True
            break
        if equity >= target and len(seen) >= days:
            won = True
            break
    return taken, round(equity, 6), bust, won


def test_account_replay_against_a_loop(spark):
    import random

    r = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        own = [(k, i, f"2024-01-{1 + i // r.randint(2, 6):02d}", float(r.randint(-70, 72))) for i in range(r.randint(1, 25))]
        own = sorted(own, key=lambda x: (x[2], x[1]))
        rows += [(k, n, d, p) for n, (_, _, d, p) in enumerate(own)]
        want[k] = replay_loop([(d, p) for _, _, d, p in own], 100.5, 200.5, 150.5, 2)
    frame = spark.createDataFrame(rows, "k int, i int, d string, p double")
    got = account.replay(frame, ["k"], ["i"], F.col("d"), F.col("p"), 100.5, 200.5, 150.5, 2).collect()
    assert {r.k: (r.taken, round(r.final_pnl, 6), r.violated_total, r.target_reached) for r in got} == want


def exits_loop(bars, i, side, sl, tp, trail, stop_bars, min_hold, off_bars):
    sign, atr, entry = (1 if side == "LONG" else -1), bars[i]["atr"], bars[i + 1]["open"]
    best, off = entry, 0
    for j in range(i + 1, len(bars)):
        b = bars[j]
        off = 0 if b["gate_long" if sign == 1 else "gate_short"] else off + 1
        best = max(best, b["high"]) if sign == 1 else min(best, b["low"])
        worst, top = (b["low"], b["high"]) if sign == 1 else (b["high"], b["low"])
        for name, level, hit in (("SL", entry - sign * sl * atr, sign * (worst - (entry - sign * sl * atr)) <= 0), ("TRAIL", best - sign * trail * atr, trail > 0 and sign * (worst - (best - sign * trail * atr)) <= 0), ("TP", entry + sign * tp * atr, sign * (top - (entry + sign * tp * atr)) >= 0)):
            if hit:
                return j, name, level
        if j - i >= stop_bars:
            return j, "TIME", b["close"]
        if j - i >= min_hold and off >= off_bars:
            return j, "REGIME_OFF", b["close"]
    return None


def test_barrier_exits_against_a_loop(spark):
    import random

    r, price, rows = random.Random(5), 100.0, []
    for k in range(300):
        o = price
        price = max(20.0, price + r.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 2.0]))
        rows.append({"symbol": "X", "time_utc": datetime(2024, 1, 1) + timedelta(minutes=5 * k), "open": o, "high": max(o, price) + r.choice([0, 0.5]), "low": min(o, price) - r.choice([0, 0.5]), "close": price, "atr": 1.0, "gate_long": r.random() < 0.6, "gate_short": r.random() < 0.6, "conf_long": r.random() < 0.2, "conf_short": r.random() < 0.2})
    bars = trades.number_bars(spark.createDataFrame(rows, "symbol string, time_utc timestamp, open double, high double, low double, close double, atr double, gate_long boolean, gate_short boolean, conf_long boolean, conf_short boolean"))
    entries = trades.candidates(bars, weekdays_only=False).withColumns({"sl": F.lit(2.0), "tp": F.lit(3.0), "trail": F.lit(2.5)})
    got = {(x.i, x.side): (x.exit_idx, x.exit_reason, x.exit_price) for x in trades.label_exits(entries, bars, 10, 3, 3, weekdays_only=False).collect()}
    want = {}
    for x in entries.collect():
        found = exits_loop(rows, x.i, x.side, 2.0, 3.0, 2.5, 10, 3, 3)
        if found:
            want[(x.i, x.side)] = found
    assert got.keys() == want.keys() and len({v[1] for v in got.values()}) >= 4
    for k, v in want.items():
        assert got[k][:2] == v[:2] and got[k][2] == pytest.approx(v[2])


def test_costs_lower_every_result(spark, data):
    from barloom.sources.fixtures import trades as fixture

    rows = metrics.cost_sensitivity(fixture(spark, data), (1.0, 2.0, 4.0), 0.0004, 1000.0, 1e6).orderBy("multiple").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert b.total_return_pct < a.total_return_pct and b.sharpe <= a.sharpe


def test_stress_is_never_better(spark):
    rows = spark.createDataFrame([("a", k, 0.01 * (k % 7 - 3)) for k in range(60)], "g string, i int, v double")
    own = resample.numbered(rows, ["g"], ["i"], "v")
    plain = resample.iid(own, ["g"], 30, 1)
    a, b = (resample.path_metrics(x, ["g"]).agg(F.avg("final")).first()[0] for x in (plain, resample.draw_rows(resample.STRESSED, own, ["g"], 30, 1)))
    assert b <= a
    assert resample.iid(own, ["g"], 30, 1).agg(F.sum("v")).first() == plain.agg(F.sum("v")).first()


def test_t_and_normal_tails():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.0366940, abs=1e-6)
    assert stats.t_tail(-1.3, 4) == pytest.approx(0.8682742, abs=1e-6)
    assert stats.normal_tail(1.959963985) == pytest.approx(0.025, abs=1e-9)


def test_average_by_chunks_equals_recursion(spark):
    rows = series(spark, 200)
    got = [r.e for r in features.ewm(rows, "close", 8, "e").orderBy("time_utc").collect()]
    want, alpha = [], 2 / 9
    for k in range(200):
        x = 100.5 + k
        want.append(x if not want else (1 - alpha) * want[-1] + alpha * x)
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9
    assert math.isfinite(got[-1])


def test_store_skips_known_days(spark, tmp_path):
    rows = series(spark, 60)
    B.write_bars(rows, f"{tmp_path}/s")
    B.write_bars(rows.withColumn("close", F.lit(0.0)), f"{tmp_path}/s")
    assert B.read_store(spark, f"{tmp_path}/s").where("close = 0").count() == 0
    B.write_bars(rows.withColumn("close", F.lit(0.0)), f"{tmp_path}/s", spark.sql("select 'X' as symbol, date '2024-01-02' as day"))
    back = B.read_store(spark, f"{tmp_path}/s")
    assert back.count() == 60 and back.where("close = 0").count() == 24


def test_a_broken_write_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    rows, path = series(spark, 60), f"{tmp_path}/s"
    day = spark.sql("select 'X' as symbol, date '2024-01-02' as day")
    B.write_bars(rows, path)
    before = sorted(map(str, B.read_store(spark, path).collect()))
    publish = B._publish

    def killed(*_):
        raise OSError("killed between data and manifest")

    monkeypatch.setattr(B, "_publish", killed)
    with pytest.raises(OSError):
        B.write_bars(rows.withColumn("close", F.lit(0.0)), path, day)
    assert sorted(map(str, B.read_store(spark, path).collect())) == before and B.last_manifest(spark, path) == 1
    monkeypatch.setattr(B, "_publish", publish)
    B.write_bars(rows.withColumn("close", F.lit(0.0)), path, day)
    after = B.read_store(spark, path)
    assert after.count() == 60 and after.where("close = 0").count() == 24 and B.last_manifest(spark, path) == 2
    assert sorted(map(str, B.read_store(spark, path, 1).collect())) == before
    B.write_bars(rows, path)  # nothing new: no version
    assert B.last_manifest(spark, path) == 2
    with pytest.raises(RuntimeError):
        B._publish(spark, B._manifest(spark, path, 2), path, 2)
    gone = B.drop_versions(spark, path, keep=1)
    assert "manifest/n=1" in gone and sum(x.startswith("data/") for x in gone) >= 2
    assert B.read_store(spark, path).where("close = 0").count() == 24

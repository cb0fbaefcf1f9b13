"""Queries that have no SQL, against NumPy."""

from __future__ import annotations

import hashlib
import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import features, folds, resample
from barloom.plans import QUERIES, metric_queries
from barloom.plans.feature_queries import features as feature_rows
from barloom.sources import fixtures as X
from tests.test_operators import series


@pytest.fixture(scope="module")
def returns(spark, data):
    out = defaultdict(list)
    for r in metric_queries.daily(spark, data).orderBy("day").collect():
        out[r.symbol, r.side].append(r.ret)
    return {k: np.array(v) for k, v in out.items()}


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def test_hac_p_values(spark, data, returns):
    got = QUERIES["M10_hac_test"](spark, data).collect()
    assert {(r.symbol, r.side) for r in got} == set(returns)
    for r in got:
        x = returns[r.symbol, r.side]
        n, u = len(x), x - x.mean()
        lags = max(1, math.floor(4 * (n / 100) ** (2 / 9)))
        v = u @ u + sum(2 * (1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1))
        t = x.mean() / (math.sqrt(v) / n)
        assert r.t_stat == pytest.approx(t, rel=1e-6) and r.p_value == pytest.approx(tail(t), abs=1e-9)
        assert r.verdict.startswith("PASS" if tail(t) < 0.05 else "WARN" if tail(t) < 0.1 else "FAIL")


def test_deflated_sharpe(spark, data, returns):
    for r in QUERIES["M13_deflated_sharpe"](spark, data).collect():
        x = returns[r.symbol, r.side]
        n, d = len(x), x - x.mean()
        sr = x.mean() / x.std(ddof=1)
        m2 = (d**2).mean()
        g1, g2 = (d**3).mean() / m2**1.5, (d**4).mean() / m2**2 - 3
        skew, kurt = g1 * math.sqrt(n * (n - 1)) / (n - 2), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
        log_n = math.log(18)
        z = (sr - math.sqrt(2 * log_n) * (1 - 0.5772156649 / (2 * log_n)) / math.sqrt(n)) / math.sqrt((1 + 0.5 * sr**2 - skew * sr + kurt / 4 * sr**2) / n)
        assert r.sr == pytest.approx(sr, rel=1e-8) and r.z == pytest.approx(z, rel=1e-6) and r.p_value == pytest.approx(tail(z), abs=1e-9)


def test_t_test_by_integration(spark, data):
    groups = defaultdict(list)
    for r in X.trades(spark, data).where("segment = 'OOS'").collect():
        groups[r.symbol, r.side, r.fold_id].append(r.gross_pnl)
    got = QUERIES["M14_t_test"](spark, data).collect()
    assert len(got) == len(groups)
    for r in got:
        x = np.array(groups[r.symbol, r.side, r.fold_id])
        n = len(x)
        if n < 5:
            assert r.p_value == 1.0
            continue
        t, df = x.mean() / (x.std(ddof=1) / math.sqrt(n)), n - 1
        grid = np.linspace(0, abs(t), 20001)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
        area = np.sum((density[1:] + density[:-1]) / 2) * (grid[1] - grid[0])
        assert r.p_value == pytest.approx(0.5 - math.copysign(area, t), abs=1e-6)


def test_fingerprints_of_files(spark, tmp_path):
    from barloom.sources import bars as B

    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/t")
    got = {os.path.basename(r.path): (r.size, r.sha256) for r in B.fingerprints(spark, f"{tmp_path}/t").collect()}
    want = {}
    for name in os.listdir(f"{tmp_path}/t"):
        if name.endswith(".parquet"):
            body = open(f"{tmp_path}/t/{name}", "rb").read()
            want[name] = (len(body), hashlib.sha256(body).hexdigest())
    assert got == want
    now = B.fingerprints(spark, f"{tmp_path}/t")
    log = now.limit(1).withColumn("logged_at", F.lit(1))
    assert sorted(r.status for r in B.changed_files(now, log).collect()) == ["NEW", "SAME"]


def test_screening(spark, data):
    from barloom.operators.gates import trend_gate

    rows = features.forward_returns(trend_gate(feature_rows(spark, data)), (1, 3, 6, 12)).where("gate_long").collect()
    got = QUERIES["T20_screening"](spark, data).collect()
    for r in got:
        own = np.array([x[f"fwd_{r.horizon}"] for x in rows if x.symbol == r.symbol and x[f"fwd_{r.horizon}"] is not None])
        assert r.n == len(own) and r.mean_ret == pytest.approx(own.mean()) and r.low <= r.high and r.significant == (r.low > 0)
        if len(own) > 1:
            spread = own.std() / math.sqrt(len(own))
            assert abs(r.low - (own.mean() - 1.96 * spread)) < 1.5 * spread + 1e-12
    assert {r.symbol for r in got} == {r.symbol for r in rows if r.fwd_1 is not None}


def test_a_replicate_holds_what_a_bootstrap_holds(spark):
    """63 % of the rows of a series, for lengths that a congruence would cycle through; and the spread of the mean."""
    for n in (600, 1201):
        rows = spark.createDataFrame([(k, float(k % 17)) for k in range(n)], "t int, v double")
        draws = resample.iid(resample.numbered(rows, [], ["t"], "v"), [], 200, 42)
        got = draws.groupBy("rep").agg(F.countDistinct("src").alias("d"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).collect()
        assert len(got) == 200 and {r.n for r in got} == {n}
        assert 0.61 < np.mean([r.d for r in got]) / n < 0.65
        own = np.array([k % 17 for k in range(n)])
        assert np.std([r.m for r in got]) == pytest.approx(own.std() / math.sqrt(n), rel=0.2)


def test_stationary_blocks(spark):
    """Neighbours in a replicate are neighbours in the series, but for one place in so many."""
    n, size = 2000, 10
    rows = spark.createDataFrame([(k, float(k)) for k in range(n)], "t int, v double")
    draws = resample.stationary(resample.numbered(rows, [], ["t"], "v"), [], 5, size, 42).orderBy("rep", "i").collect()
    for rep in range(5):
        v = np.array([r.v for r in draws if r.rep == rep])
        assert len(v) == n and np.mean((v[1:] - v[:-1]) % n == 1) == pytest.approx(1 - 1 / size, abs=0.03)


def test_all_methods_are_the_single_ones(spark):
    rows = spark.createDataFrame([(g, k, ((k * 37 + ord(g)) % 101 - 50) / 1000) for g in "ab" for k in range(80)], "g string, t int, v double")
    own = resample.numbered(rows, ["g"], ["t"], "v")
    got = {(r.g, r.method, r.metric): (r.p5, r.p50, r.p95) for r in resample.all_methods(own, ["g"], 50, 5, 7).collect()}
    stressed = resample.draw_rows(resample.STRESSED, own, ["g"], 50, 7)
    for name, draws in (("iid", resample.iid(own, ["g"], 50, 7)), ("block", resample.circular_blocks(own, ["g"], 50, 5, 7)), ("stressed", stressed)):
        for r in resample.path_quantiles(resample.path_metrics(draws, ["g"]), ["g"]).collect():
            assert got[r.g, name, r.metric] == pytest.approx((r.p5, r.p50, r.p95))
    assert len(got) == 12 and all(got[g, "stressed", "final"][1] < got[g, "iid", "final"][1] for g in "ab")


def test_risk_of_a_sure_gain(spark):
    rows = spark.createDataFrame([("a", k, 0.01) for k in range(30)], "g string, t int, v double")
    r = resample.series_risk(resample.resampled_paths(resample.numbered(rows, ["g"], ["t"], "v"), ["g"], 20, {"own": resample.Draw("stationary")}, 1), ["g"]).first()
    assert r.mean_low == pytest.approx(0.01) and r.mean_high == pytest.approx(0.01) and r.p_loss == 0 and r.p_drawdown == 0 and r.mdd_low == 0
    assert r.final_low == pytest.approx(1.01**30)


def test_fold_ids_beyond_a_hundred(spark):
    bounds = spark.sql("select 'X' as symbol, timestamp '2024-01-01' as first, timestamp '2025-01-01' as last")
    ids = [r.fold_id for r in folds.rolling_folds(bounds, 10, 1, 4, 2).collect()]
    assert len(ids) == len(set(ids)) > 120 and "F05" in ids and "F105" in ids


def test_averages_of_a_day_of_many_bars(spark):
    rows = spark.sql("select 'X' as symbol, timestamp '2024-01-01' + make_dt_interval(0, 0, cast(id as int)) as time_utc, cast(100 + id % 7 as double) as close from range(1440)")
    for span in (1, 3, 20):
        keep, want = 1 - 2 / (span + 1), []
        for k in range(1440):
            x = 100.0 + k % 7
            want.append(x if k == 0 else want[-1] * keep + x * (1 - keep))
        got = [r.e for r in features.ewm(rows, "close", span, "e").orderBy("time_utc").collect()]
        assert got == pytest.approx(want)
    flat = features.ewm(rows.withColumn("close", F.lit(5.0)), "close", 3, "e", adjust=True).collect()
    assert [r.e for r in flat] == pytest.approx([5.0] * 1440)


def test_late_bars_join_a_run_within_the_delay(spark, tmp_path):
    from barloom.streaming import ingest as I

    place = f"{tmp_path}/gates"
    bars = series(spark, 60).select("symbol", "time_utc", F.lit(True).alias("gate"))
    hours = F.expr("cast((unix_timestamp(time_utc) - unix_timestamp(timestamp '2024-01-01')) / 3600 as int)")
    bars.where(hours.isin(0, 1, 3, 4)).coalesce(1).write.parquet(place)
    bars.where(hours.isin(2, 59)).coalesce(1).write.mode("append").parquet(place)
    got = I.run_to_end(I.confirmations(I.stream_of(spark, place, 1), 5, 0, delay="5 hours"), "late").collect()
    assert [(r.time_utc.hour, r.streak) for r in got] == [(4, 5)]

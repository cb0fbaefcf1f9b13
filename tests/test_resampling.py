"""Resampling: all symbols and segments, arrays against rows, long series in blocks, rules against windows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import account, resample
from barloom.plans import QUERIES
from barloom.scratch import scratch_folder
from barloom.sources import fixtures

DRAWS = {"iid": resample.Draw("iid"), "circular": resample.Draw("circular", 5), "plain": resample.Draw("plain", 4), "stationary": resample.Draw("stationary"), "stressed": resample.STRESSED}


def groups(spark, data):
    return {tuple(r) for r in fixtures.trades(spark, data).select("symbol", "segment", "fold_id").distinct().collect()}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    sizes = {"a": 300, "b": 41, None: 7, "one": 1}
    values = {"b": [0.5, -1.0, 0.1, -2.0, 0.3, *rng.normal(0, 0.4, 36)]}
    rows = [(k, t, float(x)) for k, n in sizes.items() for t, x in enumerate(values.get(k, rng.normal(0, 0.02, n)))]
    place = scratch_folder(spark, "test")
    resample.numbered(spark.createDataFrame(rows, "g string, t int, v double"), ["g"], ["t"], "v").write.parquet(place)
    return spark.read.parquet(place)


def test_interval_has_a_width_for_all_groups(spark, data):
    got = QUERIES["B1_bootstrap_mean"](spark, data).collect()
    assert {(r.symbol, r.segment, r.fold_id) for r in got} == groups(spark, data)
    assert sum(r.low < r.mean < r.high for r in got) > 0.9 * len(got)


def test_final_equity_varies(spark, data):
    for name in ("B2_iid_paths", "B4_stressed_paths"):
        got = [r for r in QUERIES[name](spark, data).collect() if r.metric == "final"]
        assert {(r.symbol, r.segment, r.fold_id) for r in got} == groups(spark, data)
        assert sum(r.p5 < r.p50 < r.p95 for r in got) > 0.9 * len(got)


def test_rules_are_replayed_for_both_segments(spark, data):
    assert {(r.segment, r.replicates) for r in QUERIES["B5_resampled_rules"](spark, data).collect()} == {("IS", 1000), ("OOS", 1000)}


def test_ten_thousand_draws_of_risk(spark, data, monkeypatch):
    seen = {}
    inner = resample.resampled_paths
    monkeypatch.setattr(resample, "resampled_paths", lambda s, k, reps, *a: seen.setdefault("out", (reps, inner(s, k, reps, *a)))[1])
    got = QUERIES["B6_stationary_bootstrap"](spark, data).collect()
    assert seen["out"][0] == 10_000 and len(got) == 6
    assert all(r.mean_low < r.mean_high and r.mdd_low <= r.mdd_high <= 0 and 0 <= r.p_loss <= 1 for r in got)


def by_key(rows):
    return {(r.g, r.rep): (r.final, r.mdd, r["mean"], r.std) for r in rows.collect()}


@pytest.mark.parametrize("name", DRAWS)
def test_arrays_fold_as_rows_do(spark, series, name):
    """Of series by arrays, by rows in blocks, and by numpy over the drawn rows."""
    draw = DRAWS[name]
    rows = resample.draw_rows(draw, series, ["g"], 6, 11).cache()
    got = by_key(resample.resampled_paths(series, ["g"], 6, {"x": draw}, 11))
    paths = {}
    for r in rows.orderBy("i").collect():
        paths.setdefault((r.g, r.rep), []).append(r.v)
    assert set(got) == set(paths) and len(got) == 24
    for k, v in paths.items():
        want = resample.path_fold(np.array(v))
        assert got[k] == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("name", ["iid", "stressed"])
def test_long_series_in_blocks(spark, series, monkeypatch, name):
    want = by_key(resample.resampled_paths(series, ["g"], 5, {"x": DRAWS[name]}, 3))
    monkeypatch.setattr(resample, "LONGEST", 40)
    monkeypatch.setattr(resample, "PATH_BLOCK", 16)
    got = by_key(resample.resampled_paths(series, ["g"], 5, {"x": DRAWS[name]}, 3))
    assert set(got) == set(want) and len(got) == 20
    for k in want:
        assert got[k] == pytest.approx(want[k], nan_ok=True)


def test_geometric_lengths():
    bits, sizes = resample.Bits(), []
    for rep in range(200):
        own, _ = resample._lengths(1000, 8, bits, 5, rep)
        assert own.sum() == 1000 and own.min() >= 1
        sizes += own[:-1].tolist()
    sizes = np.array(sizes)
    assert sizes.mean() == pytest.approx(8, rel=0.05) and (sizes == 1).mean() == pytest.approx(1 / 8, abs=0.02)
    own, _ = resample._lengths(50, 1, bits, 5, 0)
    assert own.tolist() == [1] * 50


def test_draws_are_those_of_the_rows(spark):
    rows = spark.range(1).selectExpr("3 as rep", "explode(sequence(0, 99)) as i")
    want = [r._bits for r in resample.with_bits(rows, F.col("i"), 42).orderBy("i").collect()]
    assert resample.Bits().of(42, 3, 100).tolist() == want


def test_rules_as_windows_replay_them(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(g, t, float(np.round(x, 6))) for g, s in (("a", 30.0), ("b", 4.0), ("c", 90.0)) for t, x in enumerate(rng.normal(1, s, 60))]
    days = resample.numbered(spark.createDataFrame(rows, "g string, t int, v double"), ["g"], ["t"], "v")
    rules = (60.0, 120.0, 100.0, 2)
    key = lambda rows: {(r.g, r.rep): tuple(round(r[c], 6) for c in account.REPLAY_FIELDS) for r in rows.collect()}
    got = key(resample.resampled_rules(days, ["g"], 20, DRAWS["plain"], 4, *rules))
    monkeypatch.setattr(resample, "LONGEST", 10)
    assert key(resample.resampled_rules(days, ["g"], 20, DRAWS["plain"], 4, *rules)) == got and len(got) == 60
    assert len(set(v[:3] for v in got.values())) >= 4


def test_no_series(spark, series):
    assert resample.resampled_paths(series.limit(0), ["g"], 5, DRAWS, 3).count() == 0


def test_hash_of_every_length():
    import hashlib

    bits = resample.Bits()
    for seed, rep, n in ((1, 0, 12), (42, 999, 20_000), (4_000_000_000, 123_456, 101)):
        want = [int(hashlib.md5(b"%d:%d:%d" % (seed, rep, i)).hexdigest()[:13], 16) for i in range(n)]
        assert bits.of(seed, rep, n).tolist() == want


def test_a_series_of_a_million_values_is_an_array(spark, monkeypatch):
    """Such series took rows for every draw; parts of a unit and several units give the same."""
    monkeypatch.setattr(resample, "path_metrics", None)
    rows = spark.range(1_200_000).selectExpr("if(id % 12 = 0, 'b', 'a') as g", "id as t", "(id % 13 - 6) / 1000D as v")
    series = resample.numbered(rows, ["g"], ["t"], "v")
    got = by_key(resample.resampled_paths(series, ["g"], 3, {"x": DRAWS["circular"]}, 1))
    monkeypatch.setattr(resample, "UNIT_VALUES", 50_000)
    assert by_key(resample.resampled_paths(series, ["g"], 3, {"x": DRAWS["circular"]}, 1)) == got and len(got) == 6


def test_paths_of_long_losing_series_do_not_underflow():
    """400,000 losses bring equity below the least floating-point number, as many gains bring it back."""
    v = np.r_[np.full(400_000, -0.004), np.full(400_000, 0.004 / 0.996)]
    final, mdd, _, _ = resample.path_fold(v)
    assert final == pytest.approx(1.0, abs=1e-9) and mdd == -1.0
    assert resample.path_fold(np.array([0.5, -1.0, 0.5]))[:2] == (0.0, -1.0)


def test_stress_is_sized_once_and_all_series_share_a_unit(spark, monkeypatch):
    """Sizes were drawn again for each look at the series, and a value took eight bytes of a unit."""
    seen, inner = [], resample._replicates
    monkeypatch.setattr(resample, "_replicates", lambda own, total, *a: seen.append((total, a[-1], own.columns)) or inner(own, total, *a))
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 'a', 'b') as g", "id as t", "(id % 13 - 6) / 1000D as v")
    own = resample.numbered(rows, ["g"], ["t"], "v")
    place = scratch_folder(spark, "test")
    own.write.parquet(place)
    out = resample.resampled_paths(spark.read.parquet(place), ["g"], 4, {"x": resample.STRESSED}, 3, ("final", "mdd"))
    assert [f for _, f, _ in seen] == [("_size",), ("final", "mdd")] and seen[0][0] < 2 * 40_000
    assert "_size" in seen[1][2]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString() and out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    assert {(r.g, r.rep) for r in out.collect()} == {(g, k) for g in "ab" for k in range(4)}


@pytest.mark.parametrize("name", ["iid", "circular", "stressed"])
def test_laps_and_steps_do_not_show(spark, monkeypatch, name):
    """Few values or as many as positions, laps and steps that end within a series, ruin on the way."""
    rng = np.random.default_rng(8)
    draw = DRAWS[name]
    monkeypatch.setattr(resample, "LAP", 4000)
    monkeypatch.setattr(resample, "STEP", 700)
    few = rng.choice([-0.05, 0.01, 0.012], 9001)
    for v in (few, rng.normal(0, 0.01, 5003), few[:3]):
        own, at = np.unique(v, return_inverse=True)
        piece = (own, at.astype(np.uint8).tobytes()) if len(own) < len(v) else (v, None)
        one, bits = resample.coded([piece], 5), resample.Bits()
        path = resample.Path(draw, one, 0.004, resample.PATH_FIELDS)
        resample.folded([one], [{"x": path}], {"x": draw}, 6, 2)
        assert one.values().tolist() == v.tolist()
        assert path.facts() == pytest.approx(resample.path_fold(resample.drawn(draw, v, bits, 6, 2, 0.004)), rel=1e-9, abs=1e-15)

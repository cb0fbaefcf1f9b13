"""Correlations by tiles and HAC statistics by blocks of positions, against numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from barloom.operators import metrics, stats


def test_correlations_by_tiles(spark):
    rng = np.random.default_rng(6)
    names = [f"s{k}" for k in range(23)] + ["é", "flat"]
    values = {n: rng.normal(0.01, 0.02, 90) for n in names}
    values["flat"][:] = 0.3
    start, rows, held = dt.date(2024, 1, 1), [], {}
    for n in names:
        for d in range(90):
            if rng.random() < 0.8:
                held[n, d] = None if rng.random() < 0.1 else float(values[n][d])
                rows.append((n, start + dt.timedelta(days=d), held[n, d]))
    daily = spark.createDataFrame(rows, "symbol string, day date, ret double").repartition(5)
    for tile, days in ((256, 256), (4, 7)):
        got = {(r.a, r.b): (r.rho, r.days) for r in metrics.correlations(daily, tile, days).collect()}
        assert len(got) == 25 * 24 // 2 and all(a < b for a, b in got)
        for (a, b), (rho, n) in got.items():
            both = [d for d in range(90) if (a, d) in held and (b, d) in held]
            pairs = [(held[a, d], held[b, d]) for d in both if held[a, d] is not None and held[b, d] is not None]
            assert n == len(both)
            if "flat" in (a, b):
                assert rho is None
            else:
                assert rho == pytest.approx(np.corrcoef(*zip(*pairs, strict=True))[0, 1], abs=1e-9)
    assert metrics.correlations(daily.limit(0)).count() == 0


def hac(x, lags):
    u, n = x - x.mean(), len(x)
    v = u @ u + sum(2 * (1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, min(lags, n - 1) + 1))
    return x.mean() / (np.sqrt(v) / n)


@pytest.mark.parametrize(("lags", "block"), [(None, 1024), (60, 1024), (60, 16), (1, 7)])
def test_hac_of_any_number_of_lags(spark, monkeypatch, lags, block):
    monkeypatch.setattr(stats, "LAG_BLOCK", block)
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(0.1, 1, 700).cumsum() * 0.01, "b": rng.normal(0.2, 1, 61), None: rng.normal(0.5, 1, 9), "few": np.array([1.0, 2.0, 3.0])}
    rows = [(k, t, float(x)) for k, v in series.items() for t, x in enumerate(v)]
    out = stats.hac_t(spark.createDataFrame(rows, "g string, t int, ret double"), ["g"], order="t", lags=lags).collect()
    assert len(out) == 4
    for r in out:
        own = series[r.g]
        most = lags or max(1, int(np.floor(4 * (len(own) / 100) ** (2 / 9))))
        assert (r.n_obs, r.max_lags) == (len(own), most)
        assert r.t_stat is None if r.g == "few" else r.t_stat == pytest.approx(hac(own, most))

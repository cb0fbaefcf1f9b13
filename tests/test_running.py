"""Running values by blocks of the order: as one pass over each key gives them, and with no key in one task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, running

N = 90


@pytest.fixture
def trades(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(k, i, float(x)) for k in ("a", None) for i, x in enumerate(rng.choice([-0.5, -0.2, 0.0, 0.3, 0.6], N))]
    rows += [("b", i, x) for i, x in enumerate([-1.5] * 3 + [0.1] * 20 + [-1.0] + [0.2] * 20)] + [("c", 5, None), ("c", 20, 0.5), ("c", 40, None)]
    return spark.createDataFrame(rows, "k string, i int, r double").repartition(5)


def by_key(rows):
    found = {}
    for r in sorted(rows.collect(), key=lambda r: r.i):
        found.setdefault(r.k, []).append(r)
    return found


def test_equity_by_blocks(trades):
    added, compound = (by_key(f(trades, ["k"], ["i"], "r")) for f in (metrics.additive_equity, metrics.compound_equity))
    assert set(added) == set(compound) == {"a", None, "b", "c"}
    for k in ("a", None, "b"):
        x = np.array([r.r for r in added[k]])
        total, product = np.cumsum(x), np.cumprod(1 + x)
        top, peak = np.maximum.accumulate(total), np.maximum(np.maximum.accumulate(product), 1)
        for name, want, got in (("cum_ret", total, added), ("drawdown", total - top, added), ("equity", product, compound), ("peak", peak, compound), ("drawdown", product / peak - 1, compound)):
            assert [r[name] for r in got[k]] == pytest.approx(want, abs=1e-9), (k, name)
    assert [r.cum_ret for r in added["c"]] == [None, 0.5, 0.5]


def test_streaks_by_blocks(trades):
    got = {r.k: (r.max_wins, r.max_losses) for r in metrics.streaks(trades, ["k"], ["i"], "r").collect()}

    def longest(values, sign):
        best = n = 0
        for v in values:
            n = n + 1 if v is not None and np.sign(v) == sign else 0
            best = max(best, n)
        return best

    for k, rows in by_key(trades).items():
        assert got[k] == tuple(longest([r.r for r in rows], s) for s in (1, -1)), k


@pytest.mark.parametrize("name", ["additive_equity", "compound_equity"])
def test_no_task_holds_a_key(spark, monkeypatch, name):
    monkeypatch.setattr(running, "BLOCK", 7)
    monkeypatch.setattr(running, "TASK_ROWS", 50)
    rows = spark.range(1000).selectExpr("'a' AS k", "id AS i", "0.001D AS r")
    tasks = getattr(metrics, name)(rows, ["k"], ["i"], "r").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 1000 and max(r["count"] for r in tasks) < 500


@pytest.mark.parametrize("name", ["M9_rules_by_cost", "T11_risk_sweep"])
def test_trades_are_multiplied_where_they_lie(spark, data, name):
    """Costs and risks are dealt with after trades have moved to their day of entry, not before."""
    from barloom.plans import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode") < plan.index("RepartitionByExpression")

"""Account rules for several cases of money at once: as for each case by itself, without a row for each case."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import account
from barloom.plans import QUERIES


@pytest.mark.parametrize("name", ["M9_rules_by_cost", "T11_risk_sweep"])
def test_trades_are_single_rows_until_days_are_summed(spark, data, name):
    """Every case was a row of its own in the exchange and sorts by blocks of the order."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode") < plan.index("Join")


def test_cases_at_once(spark):
    rng = np.random.default_rng(12)
    rows = [(k, i, int(i // 6 + rng.integers(0, 3)), float(x)) for k in ("a", None, "b") for i, x in enumerate(rng.normal(0.2, 9, 80))]
    trades = spark.createDataFrame(rows, "k string, i int, d int, p double")
    cases, rules = (0.5, 1.0, 3.0, 40.0), (20.0, 60.0, 45.0, 2)
    together = account.replay(trades, ["k"], ["i"], F.col("d"), {c: F.col("p") * F.lit(c) for c in cases}, *rules, case="scale")
    apart = trades.withColumn("scale", F.explode(F.array(*map(F.lit, cases))))
    apart = account.replay(apart, ["k", "scale"], ["i"], F.col("d"), F.col("p") * F.col("scale"), *rules)
    key = lambda r: (r["k"] or "", r["scale"])
    got, want = (sorted((r.asDict() for r in x.collect()), key=key) for x in (together, apart))
    assert len(got) == 12 and len({r["taken"] for r in got}) > 4
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)

"""Exact quantiles by selection over ranges, against sorted lists: ties, nulls, a large group, no rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.functions import ranks


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = [("big", float(x), float(-x)) for x in rng.normal(size=5000)] + [("tie", 1.0, 2.0)] * 3000 + [("tie", 0.5, float("nan"))] * 10
    out += [(None, float(x), None) for x in rng.integers(0, 5, 40)] + [("one", 3.0, 4.0), ("none", None, float("nan")), ("inf", float("inf"), -0.0), ("inf", float("-inf"), 0.0)]
    return out


def sorted_of(rows, key, place):
    return sorted(r[place] for r in rows if r[0] == key and r[place] is not None and not math.isnan(r[place]))


def test_ranks_of_groups(spark, rows):
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    wanted = {"a": {"a0": 0.0, "a3": 0.33, "a9": 0.9, "a100": 1.0}, "b": {"b5": 0.5}}
    rules = {
        ranks.nearest_ranks: lambda v, q: v[int(np.floor((len(v) - 1) * q + 0.5))],
        ranks.floor_ranks: lambda v, q: v[min(int(np.floor(len(v) * q)), len(v) - 1)],
        ranks.linear_ranks: lambda v, q: float(np.percentile(v, q * 100)),
    }
    for rule, by_hand in rules.items():
        got = {r.g: r for r in rule(df, ["g"], wanted).collect()}
        assert set(got) == {"big", "tie", None, "one", "inf"}
        for g, r in got.items():
            if g == "inf" and rule is ranks.linear_ranks:
                continue
            for place, column in ((1, "a"), (2, "b")):
                own = sorted_of(rows, g, place)
                for name, q in wanted[column].items():
                    assert (r[name] is None) if not own else r[name] == pytest.approx(by_hand(own, q)), (rule, g, name)


def test_ranks_of_a_whole_table(spark, rows):
    df = spark.createDataFrame(rows, "g string, a double, b double")
    own = sorted(x for g in {r[0] for r in rows} for x in sorted_of(rows, g, 1))
    assert ranks.floor_rank(df, [], "a", {"q": 0.25}).first().q == own[int(len(own) * 0.25)]
    assert ranks.floor_rank(df, [], "a", {"q": 0.25}, bounded=True).first().q == own[int(len(own) * 0.25)]
    assert ranks.floor_rank(df.limit(0), ["g"], "a", {"q": 0.25}).count() == 0
    assert ranks.linear_ranks(df.limit(0), [], {"a": {"q": 0.25}}).first().q is None

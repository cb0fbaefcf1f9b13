"""Chains of trades by pointers against a loop, and entries met across blocks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from barloom.operators import trades


def loop(rows, cooldown):
    """What a position that holds one trade at a time takes: (group, i)."""
    groups = defaultdict(dict)
    for g, i, end in rows:
        groups[g][i] = min(end, groups[g].get(i, end))
    out = set()
    for g, own in groups.items():
        free = None
        for i in sorted(own):
            if free is None or i >= free:
                out.add((g, i))
                free = own[i] + cooldown + 1
    return out


@pytest.mark.parametrize("span", [4096, 8])
def test_chain_is_the_loop(spark, monkeypatch, span):
    monkeypatch.setattr(trades, "SPAN", span)
    rng = np.random.default_rng(span)
    rows = [(g, int(i), int(i + rng.integers(1, 30))) for g, n in (("a", 400), ("b", 30), (None, 60)) for i in rng.choice(600, n, replace=False)]
    rows += [("dense", i, i) for i in range(300)] + [("far", 0, 5), ("far", 1, 3), ("far", 9_000, 9_001), ("tie", 4, 9), ("tie", 4, 6), ("tie", 9, 10), ("tie", 9, 10), ("one", 3, 4)]
    labelled = spark.createDataFrame(rows, "g string, i int, exit_idx int").repartition(4)
    for cooldown in (0, 3):
        got = [(r.g, r.i) for r in trades.without_overlap(labelled, cooldown, ("g",)).collect()]
        assert len(got) == len(set(got)) and set(got) == loop(rows, cooldown)
    assert trades.without_overlap(labelled.limit(0), 1, ("g",)).count() == 0


def test_next_entry_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(trades, "SPAN", 10)
    entries = spark.createDataFrame([("a", 3), ("a", 57), ("b", 12)], "symbol string, i int")
    exits = spark.createDataFrame([("a", 0), ("a", 2), ("a", 3), ("a", 56), ("a", 57), ("a", 900), ("b", 1), ("c", 1)], "symbol string, exit_idx int")
    got = {(r.symbol, r.exit_idx): r.next_i for r in trades.next_match(exits, entries, 0).collect()}
    assert got == {("a", 0): 3, ("a", 2): 3, ("a", 3): 57, ("a", 56): 57, ("a", 57): None, ("a", 900): None, ("b", 1): 12, ("c", 1): None}

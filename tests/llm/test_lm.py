"""LM scoring against plain counting."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import lm


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t in rows]
    c = Counter(w for _, held, ws in docs if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, held, ws in docs), key=str)


def test_counts_and_base_score(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "the of"), (9001, None), (9002, ""), (9002, ""), (9003, "unheard-of unheard-of x"), (9009, "of the " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score_documents(frame).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def plain_scores(rows, held):
    """The model by dictionaries: expectation maximisation over all tokens, no grid."""
    docs = [(i, held(i), [*(t or "").split(), None]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, out, ws in docs:
        if not out:
            for k, w in enumerate(ws):
                one[w] += 1
                two[ws[k - 1] if k else None, w] += 1
                three[(ws[k - 2] if k > 1 else None, ws[k - 1], w) if k else None] += 1
    n, v = sum(one.values()), len(one)

    def parts(ws, k, less):
        b = ws[k - 1] if k else None
        pair = (ws[k - 2] if k > 1 else None, b) if k else None
        outer = two[pair] if k and two[pair] >= lm.CUT else 0
        triple = max(three[(*pair, ws[k])] - less, 0) if outer else 0
        outer, context, joint, count = max(outer - less, 0), max(one[b] - less, 0), max(two[b, ws[k]] - less, 0), max(one[ws[k]] - less, 0)
        octave = lambda c: min(c.bit_length(), lm.BUCKETS - 1)
        return lm.BUCKETS + octave(outer) if outer else octave(context), [triple / max(outer, 1), joint / max(context, 1), count / max(n - less, 1), 1 / (v + 1)]

    cells = {}
    for _, out, ws in docs:
        if not out:
            for k in range(len(ws)):
                b, e = parts(ws, k, 1)
                cells.setdefault(b, []).append(e)
    body = b""
    for b, es in sorted(cells.items()):
        es, w = np.array(es), np.full(4, 0.25)
        for _ in range(lm.ROUNDS):
            share = es * w
            share /= share.sum(1, keepdims=True)
            w = share.sum(0) + 0.1 * (es.max(0) > 0)
            w /= w.sum()
        body += np.r_[b, w].tobytes()
    table = lm.table_of(body)
    out = {}
    for i, _, ws in docs:
        told = [parts(ws, k, 0) for k in range(len(ws))]
        out[i] = sum(math.log10(float(table[b] @ np.array(e))) for b, e in told)
    return out


def test_scores_against_plain_expectation_maximisation(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(60):
        text = [r.choice(words[:8])]
        for _ in range(r.randint(0, 80)):
            text.append(words[(words.index(text[-1]) * 7 + (words.index(text[-2]) if len(text) > 1 else 0) + r.choice([1, 1, 1, 2, 5])) % 40])
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "unseen words w1 w2 only"), (103, "w1 " * 300)]
    got = {x.doc_id: x.score for x in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 == 2).collect()}
    want = plain_scores(rows, lambda i: i % 7 == 2)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], rel=0.01), i


def test_longer_context_counts(spark):
    """What follows a word depends on the word before it: only a trigram tells."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(r) + " x") for i in range(120) for r in [["p q r", "s q t"][(i + k) % 2] for k in range(12)] and [[["p q r", "s q t"][random.Random(i * 50 + k).randrange(2)] for k in range(12)]]]
    rows += [(1000, "p q r s q t p q r s q t x"), (1001, "p q t s q r p q t s q r x")]
    got = {x.doc_id: x.score for x in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert got[1000] > got[1001] + 4


def test_learns_word_order(spark):
    """On text that is a fixed cycle, held-out texts become nearly certain; shuffled ones do not."""
    cycle = "a b c d e f g h i j".split()
    rows = [(i, " ".join(cycle[(i + k) % 10] for k in range(60))) for i in range(200)] + [(1000 + i, " ".join(cycle[(i + k * k * 7) % 10] for k in range(60))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in lm.score_documents(frame, F.col("doc_id") >= 190).collect()}
    assert all(got[i].score / got[i].n_tokens > -0.15 for i in range(190, 200))
    assert all(got[i].score / got[i].n_tokens < -1 for i in range(1000, 1020))


def test_mixture_is_a_distribution(spark):
    rows = [(0, "a b a c"), (3, "a a b"), (1, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    r = {x.doc_id: x for x in lm.score_documents(frame, F.col("doc_id") == 1).collect()}
    assert r[1].n_known == 2 and r[1].train_tokens == 9 and r[1].held_out
    assert r[1].base_score == pytest.approx(math.log10(3 / 14) + math.log10(3 / 14))


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []

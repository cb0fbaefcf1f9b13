"""Suffix-array and block-anchor dedup against dictionaries of all windows."""

from __future__ import annotations

import hashlib
import random
import re

from barloom.llm import block_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, source string, chunk string"


def brute_bytes(rows, size=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            first[w] = min(first.get(w, 2**63 - 1), 2**63 - 1 if i is None else i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < (2**63 - 1 if i is None else i):
                gone[k : k + size] = [True] * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, size=50):
    first, split = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    for (i, *_), w in zip(rows, split, strict=True):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, 2**63 - 1), 2**63 - 1 if i is None else i)
    out = []
    for (i, *_), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (2**63 - 1 if i is None else i):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed: int, n: int = 60):
    """Shared passages at random places, copies, near copies, ties, repeated rows, null and empty texts, and a long one."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé日", k=r.randint(1, 9))) for _ in range(300)]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", "\t ", " "]) for _ in range(k))
    passages = [text(r.randint(8, 120)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            p, k = r.choice(passages), r.randint(0, len(t))
            a = r.randint(0, max(0, len(p) - 60))
            t = t[:k] + p[a : a + r.randint(30, 700)] + t[k:]
        rows.append((r.choice([i, i * 7 % 50]), t, "s", "x"))
    rows += [(3, rows[5][1], "s", None), (200, rows[5][1], None, "x"), (200, rows[5][1], None, "x"), (None, rows[5][1], None, None), (None, rows[5][1], None, None), (None, text(90), None, None)]
    rows += [(300, None, None, None), (301, "", None, None), (302, " \n ", None, None), (303, "x" * 5000, None, None), (304, "x" * 49, None, None), (305, "xy" * 2600, None, None), (306, "x" * 120, None, None), (307, "a " * 400, None, None), (308, "a " * 60, None, None)]
    rows += [(400, passages[0] * 40 + text(3000), None, None)]
    return rows


def test_bytes_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA))
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute_bytes(rows)
        for r in got.collect():
            assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_words_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        got = block_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA))
        assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute_words(rows)
        for r in got.collect():
            assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_many_chunks_give_the_same(spark, monkeypatch):
    rows = corpus(4)
    frame = spark.createDataFrame(rows, SCHEMA)
    deal = suffix_dedup.chunks.deal
    monkeypatch.setattr(suffix_dedup.chunks, "deal", lambda docs: deal(docs, chunk_bytes=9000))
    assert sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame).collect()), key=str) == brute_bytes(rows)
    assert sorted((tuple(r)[:4] for r in block_dedup.remove_repeats(frame).collect()), key=str) == brute_words(rows)


def test_query_over_the_whole_table(spark, data):
    from barloom.llm.queries import op3_suffix_array_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op3_suffix_array_dedup(spark, data).collect()), key=str) == brute_bytes(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).collect() == []
    assert block_dedup.remove_repeats(empty).collect() == []


def test_bytes_that_differ_eight_apart(spark):
    """Columns of a fixed-width table: strings whose bytes differ only in two places eight apart are different."""
    line = "the quick brown fox jumps over the lazy dog and runs away now"
    rows = [(k, f"{line[:7]}{a}{line[8:15]}{b}{line[16:50]}", "s", "x") for k, (a, b) in enumerate((a, b) for a in "0123456789abcdefgh" for b in "0123456789abcdefgh")]
    rows += [(1000 + k, t + " " + t[::-1], s, c) for k, t, s, c in rows[:40]]
    assert sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute_bytes(rows)


def test_negative_ids_come_first(spark):
    rows = [(None if i is None else i - 25 if i % 2 else -(2**62) + i, *rest) for i, *rest in corpus(5)]
    rows += [(2**63 - 2, rows[3][1], None, None), (-(2**63), rows[7][1] + "x" * 60, None, None), (0, rows[9][1], None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame).collect()), key=str) == brute_bytes(rows)
    assert sorted((tuple(r)[:4] for r in block_dedup.remove_repeats(frame).collect()), key=str) == brute_words(rows)

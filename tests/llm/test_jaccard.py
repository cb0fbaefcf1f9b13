"""The signature-tree join against comparing all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from barloom.llm import jaccard

SCHEMA = "doc_id long, text string, name string, n int"


def shingles(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows, percent=90):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and percent * len(a) <= 100 * len(b) and percent * len(b) <= 100 * len(a) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = 2**63 - 1 if r[0] is None else r[0]
        least[find(i)] = min(least.get(find(i), k), k)
    null = lambda x: None if x == 2**63 - 1 else x
    return sorted(((r[0], len(sets[i]), null(least[find(i)])) for i, r in enumerate(rows)), key=str)


def corpus(seed):
    """Copies, near copies around the threshold, chains of them, short texts, ties and nulls."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(200)] + ["The", "é", "日本"]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 12, 25, 40, 60, 90, 140, 300]))]
        text = base
        for _ in range(r.choice([1, 1, 2, 4, 9])):
            rows.append((k, " ".join(text), "x", None))
            k += r.randint(1, 3)
            text = list(text if r.random() < 0.6 else base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(text))
                text[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 2)
            text = text or ["a"]
    r.shuffle(rows)
    rows += [(500, None, None, 1), (501, "", None, 1), (502, " \n", None, None), (503, "one", None, None), (504, "ONE", None, None), (505, "one two", None, None), (506, "two one", None, None), (507, "one one one one", None, None), (508, "one one one", None, None)]
    rows += [(None, rows[0][1], None, None), (None, "alone in the world", None, None), (700, rows[3][1], None, None), (700, rows[3][1], None, None), (2, rows[9][1].upper(), None, None)]
    return rows


def got(frame, **more):
    return sorted((tuple(r) for r in jaccard.join_documents(frame, **more).collect()), key=str)


def test_against_all_pairs(spark):
    rows = corpus(1) + [(10_000 + i, t, a, b) for i, t, a, b in corpus(2) if i is not None]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_clusters_larger_than_a_task(spark):
    rows = corpus(3)
    r = random.Random(9)
    base = ["v%d" % i for i in range(120)]
    for i in range(60):
        text = list(base)
        for _ in range(r.randint(0, 2)):
            text[r.randrange(120)] = "z%d" % r.randrange(1000)
        rows.append((2000 + i, " ".join(text), None, None))
    assert got(spark.createDataFrame(rows, SCHEMA), task_shingles=1200) == brute(rows)


def test_parts_bring_all_linked_sets_together():
    """Any two linked sets share a strong key in a slot of each where they hold the number of keys needed."""
    r = np.random.default_rng(5)
    for percent in (90, 80):
        tried = 0
        for _ in range(1500):
            n = int(r.choice([r.integers(2, 12), r.integers(2, 160)]))
            a = r.permutation(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
            drop = int(r.integers(0, n * (100 - percent) // 80 + 2))
            b = np.unique(np.r_[a[drop:], r.integers(0, 2**64 - 1, int(r.integers(0, n * (100 - percent) // 80 + 2)), dtype=np.uint64)])
            a = np.unique(a)
            if not len(b) or np.array_equal(a, b) or not jaccard._linked(a, b, percent):
                continue
            tried += 1
            key, slot, strong, need = jaccard.part_keys(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), percent)
            mine, yours = set(key[slot < 2].tolist()), set(key[slot >= 2].tolist())
            good = []
            for own, other in ((slot < 2, yours), (slot >= 2, mine)):
                hit = own & np.array([k in other for k in key.tolist()])
                able = np.bincount(slot[hit], minlength=len(need)) >= need
                good.append(set(key[hit & strong & able[slot]].tolist()))
            assert good[0] & good[1]
        assert tried > 200


def test_many_unlinked_sets_beside_a_hub(spark):
    """Sets that the hub is not linked to, in many tiles, still find each other and the rest."""
    r, rows = random.Random(11), []
    base = ["v%d" % i for i in range(150)]
    for i in range(90):
        text = list(base)
        for at in range(i % 6 * 20, i % 6 * 20 + r.randint(0, 2)):
            text[at] = "z%d" % r.randrange(1000)
        for at in range(i // 15 * 4):
            text[at] = "chain%d" % at
        rows.append((3000 + i, " ".join(text), None, None))
    assert got(spark.createDataFrame(rows, SCHEMA), task_shingles=1500) == brute(rows)


def test_null_ids_spread_over_chunks(spark):
    from barloom.llm import chunks

    frame = spark.range(4000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "concat('text ', id, repeat(' word', 60)) as text")
    texts, n = chunks.deal(frame, chunk_bytes=1 << 17)
    sizes: dict[int, int] = {}
    for r in texts.packets.toArrow().to_pylist():
        table = chunks.opened(pa.table({"body": pa.array([r["body"]], pa.binary())}), texts.schema)
        sizes[r["chunk"]] = sizes.get(r["chunk"], 0) + len(table)
    assert sum(sizes.values()) == 4000
    assert len(sizes) == n > 4 and max(sizes.values()) < 2 * 4000 / n


def test_keep_one_and_empty(spark):
    rows = corpus(4)
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    want = [i for i, _, c in brute(rows) if i is None or i == c]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert jaccard.join_documents(spark.createDataFrame([], SCHEMA)).collect() == []

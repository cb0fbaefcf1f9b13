"""Base counts against plain Python, the field's sums against all labellings, and line labels of mixed documents."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import quality
from tests.llm.test_edges import brute_counts


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    return quality.train(docs, labels.where("doc_id % 2 = 0"))


def test_counts_of_odd_rows(spark, model):
    rows = [
        (None, "a b c\na b c\n" * 20, 1), (None, None, 2), (1, None, 3), (2, "", 4), (2, "", 4), (3, " \t\n \n", 5), (4, "word " * 30_000, 6), (5, "x" * 200_000, 7), (6, "#*$%&|<>" * 9 + " é日本 ok", 8),
        (7, "\n".join(f"line {k} of a long text with é number {k * k}" for k in range(4000)), 9), (7, "another text of the same id", 9), (8, "one\n\ntwo\none\none \n", 10),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int").withColumn("kept", F.lit("clash"))
    got = quality.score_documents(frame, model).collect()
    key = lambda r: str(tuple(r))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r.doc_id, *(r[c] for c in columns)) for r in got], key=key) == sorted([(i, *brute_counts(t)) for i, t, _ in rows], key=key)
    assert not any(r.base_failed and r.kept for r in got) and all(0 <= r.content_share <= 1 for r in got)
    kept = quality.filter_documents(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in got)
    assert quality.score_documents(frame.limit(0), model).count() == 0 and quality.filter_documents(frame.limit(0), model).count() == 0


def test_sums_against_all_labellings():
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(2, quality.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2)]
    lengths = [1, 3, 6]
    x, on = rng.normal(size=(3, 6, quality.FEATURES)), np.arange(6) < np.array(lengths)[:, None]
    z, seen, pairs = quality.expected(parts, x, on)
    for k, n in enumerate(lengths):
        score = x[k] @ parts[0].T
        paths = list(product((0, 1), repeat=n))
        value = np.array([parts[2][y[0]] + sum(score[t, y[t]] for t in range(n)) + sum(parts[1][a, b] for a, b in zip(y, y[1:], strict=False)) for y in paths])
        p = np.exp(value - value.max())
        assert z[k] == pytest.approx(value.max() + np.log(p.sum()))
        p /= p.sum()
        for t in range(n):
            assert seen[k, t, 1] == pytest.approx(sum(w for w, y in zip(p, paths, strict=True) if y[t]))
        for t in range(n - 1):
            for a, b in product((0, 1), repeat=2):
                assert pairs[k, t, a, b] == pytest.approx(sum(w for w, y in zip(p, paths, strict=True) if (y[t], y[t + 1]) == (a, b)))
        assert not seen[k, n:].any() and not pairs[k, max(n - 1, 0) :].any()


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    known = quality.score_documents(docs, model).join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").where("not base_failed").collect()
    assert len(known) > 150 and np.mean([r.kept == (r.quality == 1) for r in known]) >= 0.98


def test_mixed_documents_get_mixed_labels(tables, model):
    docs, labels = tables
    rows = docs.join(labels.where("quality is not null"), "doc_id").orderBy("doc_id").collect()
    lines = lambda q, mark: [x for r in rows if r.quality == q and mark(r.text) for x in r.text.split("\n")[1:] if 8 <= len(x.split()) and mark(x)]
    good = lines(1, lambda t: not any(c in t for c in "#$%&|"))
    junk = lines(0, lambda t: t.count("$") + t.count("%") > 3)
    assert len(good) > 80 and len(junk) > 10
    right = total = 0
    for k in range(8):
        text = good[10 * k : 10 * k + 5] + junk[k % len(junk) : k % len(junk) + 3] + good[10 * k + 5 : 10 * k + 10]
        want = [x not in junk for x in text]
        data = np.frombuffer("\n".join(text).encode(), np.uint8)
        _, x, _, first = quality.measure(data, np.array([0, len(data)]))
        label = quality.decode(x, first, model)
        assert 0 < label.sum() < len(label)
        right, total = right + (label == want).sum(), total + len(want)
    assert right / total > 0.95


def test_labels_of_one_kind_and_repeated_ids(spark, tables):
    docs, labels = tables
    assert quality.train(docs, labels.where("quality = 1"))["trivial"] and quality.train(docs.limit(0), labels)["trivial"] and quality.train(docs, labels.limit(0))["trivial"]
    same, twice = quality.train(docs, labels), quality.train(docs.unionByName(docs).repartition(3), labels.unionByName(labels))
    assert np.allclose(same["emission"], twice["emission"]) and np.allclose(same["transition"], twice["transition"])


def test_rare_kinds_reach_every_shard(spark, tables, monkeypatch):
    """One bad document among hundreds of good ones, cut into many shards: all good ones count, and the bad one is in each."""
    docs, labels = tables
    known = docs.join(labels.where("quality is not null"), "doc_id").select("doc_id", "quality")
    bad = known.where("quality = 0").orderBy("doc_id").limit(1)
    few = known.where("quality = 1").unionByName(bad)
    one = quality.train(docs, few)
    monkeypatch.setattr(quality, "FIT_DOCS", 40)
    many = quality.train(docs, few)
    assert not one["trivial"] and not many["trivial"]
    judged = [{r.doc_id: r.kept for r in quality.score_documents(docs.join(few.select("doc_id"), "doc_id", "left_semi"), m).collect()} for m in (one, many)]
    assert np.mean([judged[0][k] == judged[1][k] for k in judged[0]]) > 0.97

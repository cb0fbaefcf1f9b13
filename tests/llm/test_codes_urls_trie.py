"""Vector codes, URL filter and prefix trie: brute force, SQL and odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import keyed, oracles, prefix_trie, queries, url_filter, vector_codes
from tests.test_queries import compare


def test_transform_counts_sign_changes_and_keeps_distances():
    for size in (1, 2, 8, 32):
        rows = vector_codes.walsh_hadamard(np.eye(size, dtype=np.int64)).T
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(size))
    rng = np.random.default_rng(1)
    for width, high in ((1, 50), (4, 300), (5, 3), (7, 2**40)):
        x, c = rng.integers(-high, high, (200, width)), rng.integers(-high, high, (17, width))
        c[5] = c[2]
        code, error = vector_codes.nearest(x, c)
        full = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        assert code.tolist() == [int(np.argmin(row)) for row in full] and error.tolist() == full.min(1).tolist()


def codes_by_hand(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = sorted(((i, [*v, *[0] * (width - len(v))], label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step, codes = width // parts, []
    books = [[v[p * step : (p + 1) * step] for _, v, _ in kept[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        codes = [[min((sum((a - b) ** 2 for a, b in zip(v[p * step : (p + 1) * step], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [v[p * step : (p + 1) * step] for (_, v, _), c in zip(kept, codes, strict=True) if c[p][1] == k]
                    if own:
                        books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [sum(d for d, _ in c) for c in codes]
    by = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in c), e, by[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=10)], int(i) % 3) for i in rng.permutation(60)]
    rows += [(None, [0.5] * 10, None), (None, [0.25] * 10, None), (7, [1.0] * 10, 1), (7, [1.0] * 10, 1), (-4, [-0.001] * 7, 2), (90, None, 1), (91, [1.0, None], 1), (92, [float("nan")] * 10, 1), (93, [float("inf")] * 10, 1), (94, [], 5), (95, [1e30] + [0.0] * 9, 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).withColumn("error", F.lit("x"))
    got = [tuple(r) for r in vector_codes.encode(docs, parts=4, entries=8).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    want = [(*r[:2], *(e if e < 2**63 else None for e in r[2:4]), r[4]) for r in codes_by_hand(rows, 4, 8, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert vector_codes.encode(docs.limit(0)).count() == 0
    one = vector_codes.encode(spark.createDataFrame([(1, [], 1)], docs.schema[:3])).collect()
    assert [(r.code, r.error) for r in one] == [("00" * 16, 0)]


def test_totals_of_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([(None if i < 4000 else i, i) for i in range(6000)], "k long, v long")
    totals = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    got = keyed.join_totals(rows, totals, ["k"], "n").collect()
    assert len(got) == 6000 and all(r.s == (r.v if r.k is not None else 7998000) for r in got)


URLS = ["http://a.com", "http://a.com/", "https://x.EXAMPLE.com/en/1?q#f", "http://www.example.com/en/7", "http://a.www.example.com/en/7", "http://www.example.com/fr/", "ftp://net/es/", "http://notnet/es/", "http://q.net/en/1", "http://q.org/fr/#/x", "nothing", "", None, "://", "http://?x", "http://é.日本/ü x", "http://A.org:80/en/a://b", "x\ny://a.net/fr/\n"]


def pages_of(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(3)).withColumn("score", F.lit("s"))


def sql_of(name, **tables):
    con = duckdb.connect()
    for t, frame in tables.items():
        con.register(t, frame)
    return con.execute(name).df()


def test_urls(spark):
    many = URLS + ["http://good.org/de/" + str(i) for i in range(40)] + ["http://site%d.com/de/item" % i for i in range(60)] + ["http://bad%d.net/es/sale" % i for i in range(60)]
    rows = pages_of(spark, many).unionByName(pages_of(spark, ["http://q.org/de/", "http://q.org/de/", None]).withColumn("page_id", F.lit(None).cast("long")))
    got = url_filter.filter_urls(rows).toPandas()
    pages = rows.select("page_id", "url").toPandas()
    pages["page_id"] = pages["page_id"].astype("Int64")
    compare(got, sql_of(oracles.url_filter(), pages=pages))
    by = {r.page_id: r for r in got.itertuples()}
    want = [("a.com", "", None), ("a.com", "/", "com/"), ("x.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/7", "www.example.com/en/"), ("a.www.example.com", "/en/7", "www.example.com/en/"), ("www.example.com", "/fr/", "com/")]
    want += [("net", "/es/", "net/es/"), ("notnet", "/es/", None), ("q.net", "/en/1", None), ("q.org", "/fr/", None), ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("é.日本", "/ü x", None), ("a.org:80", "/en/a://b", None), ("a.net", "/fr/\n", "net/fr/")]
    assert [(by[i].host, by[i].path, by[i].rule if isinstance(by[i].rule, str) else None) for i in range(len(URLS))] == want
    assert {by[i].verdict for i in range(18, 58)} == {"allow"}
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def test_unknown_urls_without_labels_and_shuffled_grams(spark, monkeypatch):
    rows = pages_of(spark, ["http://q.org/%s" % ("y" * 100_000), "http://q.org/a", "http://q.org/a"])
    got = url_filter.filter_urls(rows).collect()
    assert [r.verdict for r in got] == ["allow"] * 3 and max(r.n_chars for r in got) == 100_007
    spread = pages_of(spark, URLS)
    want = sorted(map(tuple, url_filter.filter_urls(spread).collect()), key=str)
    monkeypatch.setattr(url_filter, "SMALL_GRAMS", 0)
    assert sorted(map(tuple, url_filter.filter_urls(spread).collect()), key=str) == want


def test_models_tell_labelled_urls_apart(spark):
    """Held-out labelled URLs of sf0.1, judged by the models alone."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_filter.judged(pages)
    weights = url_filter.model(url_filter.counted_grams(rows))
    scores = url_filter.scored(rows, weights).withColumn("step", url_filter.step_of(F.col("score"), F.col("n"))).cache()
    cut = url_filter.threshold(scores)
    held = scores.where("held AND ruled IS NOT NULL").select("ruled", (F.col("step") >= cut).alias("ok")).toPandas()
    assert len(held) > 100
    assert ((held.ruled == "allow") == held.ok).mean() > 0.9


def trie_by_hand(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        told[c].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [x[2:] for x in sorted(v)] for c, v in told.items()}
    new = {}
    for c, own in told.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        new[c] = ([] if c is None else told.get(c - int(np.fmod(c, 5)), [])[:h]) + own[h:]
    members = defaultdict(list)
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    order = lambda c: (c is None, c or 0)
    first = {k: min(v, key=order) for k, v in members.items()}
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k, v in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in v if len(new[c]) == len(k)), key=order))
        out.append((first[k], len(k), first[k[:-1]] if k else None, len(v), len(kids[k]), sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks(spark):
    rng = np.random.default_rng(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", str(rng.integers(2)) * 3) for c in range(40) for t in range(rng.integers(1, 12))]
    rows += [(50, None, None, None), (50, 1, None, ""), (50, 1, "", None), (51, 3, "user", "é" * 200_000), (52, 3, "user", "é" * 200_000), (None, 1, "user", "a"), (None, None, "user", "b"), (-7, 0, "user", "x"), (-5, 0, "user", "x"), (60, None, "u", "same"), (60, None, "u", "same")]
    rows += [(70, i, "user", str(i % 7)) for i in range(37)]
    return rows


def test_trie_of_odd_conversations(spark, talks):
    docs = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1)).withColumn("depth", F.lit("x")).repartition(5)
    got = sorted((tuple(r) for r in prefix_trie.trie(docs).collect()), key=str)
    assert got == trie_by_hand(talks)
    assert prefix_trie.trie(docs.limit(0)).count() == 0


def test_trie_in_small_pieces(spark, talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [*talks, *((c, 0, "user", "hello") for c in range(100, 900))]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.trie(docs).collect()), key=str) == trie_by_hand(rows)


def test_pieces_of_ids_make_one_digest():
    import pyarrow as pa

    names, ids = [b"a"] * 30_000 + [b"b"], [*range(30_000), 2**63 - 1]
    batches = [pa.record_batch([pa.array(names[i : i + 7000], pa.binary()), pa.array(ids[i : i + 7000], pa.int64())], ["name", "c"]) for i in range(0, 30_001, 7000)]
    pieces = list(prefix_trie.joined(iter(batches)))
    assert len(pieces) > 3
    got = {r["name"]: r["ends_sha256"] for b in prefix_trie.digested(iter(pieces)) for r in b.to_pylist()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest(), b"b": hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_url_filter", "op13_prefix_trie"])
def test_small_tables_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    compare(queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.ORACLES[name]).df())

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for the operators that SQL can check; then SQL over the whole small tables."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, decontam, license_scan, line_templates, mixing, quality, queries
from barloom.llm.session import shared_folder
from tests.test_queries import compare

ODD = [
    (1, "The cat sat. Released under the MIT License.\nReleased under the MIT License.", "a", 1), (2, None, None, 2), (3, "", "b", None), (None, "no id here\n\nReleased under the MIT License.", None, 3),
    (4, " \t\n \n", "a", 4), (5, "Job 17 took 4 s on host x9\nplain words", "b", 5), (5, "Job 17 took 4 s on host x9\nplain words", "b", 5), (6, "Job 18 took 5 s on host x2", "b", 6), (7, "Job 1 took 99 s on host y", "é", 7),
    (8, "Job 2 took 1 s on host z", "日本", 8), (9, "Job 3 took 1 s on host q", None, 9), (10, "word " * 30_000, "c", 10), (11, "x" * 200_000, "c", 11), (12, "a\nb\nA\n\nb", "c", 12),
]
SCHEMA = "doc_id long, text string, source string, n_words int"


@pytest.fixture(scope="module")
def odd(spark):
    shared_folder(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(odd=ODD, **tables):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents_p", pd.DataFrame({"doc_id": pd.array([r[0] for r in odd], "Int64"), "text": pd.Series([r[1] for r in odd], dtype=object), "source": pd.Series([r[2] for r in odd], dtype=object)}))
    con.execute("create view documents as select * from documents_p")
    for name, frame in tables.items():
        con.register(f"{name}_p", frame)
        con.execute(f"create view {name} as select * from {name}_p")
    return con


def test_mixing_odd_rows(spark, odd, empty):
    got, _ = mixing.mix_sources(odd)
    want = duck().execute(queries.ORACLES["op2_source_mixing"]).df()
    compare(got.drop("source").toPandas(), want)
    _, schedule = mixing.mix_sources(odd, block_words=100)
    rows = schedule.orderBy("source", "block").collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert [r.block for r in own] == list(range(len(own))) and all(a.end == b.start for a, b in zip(own, own[1:], strict=False))
    assert mixing.mix_sources(empty)[0].count() == 0


def test_line_templates_odd_rows(spark, odd, empty):
    compare(line_templates.digest(odd).toPandas(), duck().execute(queries.ORACLES["op5_line_templates"]).df())
    kept = line_templates.drop_templates(odd)
    assert kept.columns == odd.columns and line_templates.digest(empty).count() == 0 and line_templates.drop_templates(empty).count() == 0
    jobs = {r.doc_id: r.text for r in kept.where(F.col("doc_id").between(5, 9)).collect()}
    assert jobs == {5: ODD[5][1]}  # the first holder keeps the template's line; the others had nothing else


def test_template_generalises_a_field_without_digits(spark):
    rows = [(k, f"connection from host {name} was closed by the peer", "s", 1) for k, name in enumerate(["alpha", "beta", "gamma", "delta", "omega", "sigma"])]
    rows += [(100 + k, f"{a} quite different sentence of nine words {a}", "s", 1) for k, a in enumerate("abcdefgh")]
    got = {r.doc_id: r.n_dropped for r in line_templates.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(6)] == [0, 1, 1, 1, 1, 1] and all(got[k] == 0 for k in got if k >= 100)


def test_many_notices_in_one_text(spark):
    """A NOTICE file of 40 clean or damaged notices; some SQL beside, on texts of a few."""
    rng = np.random.default_rng(4)
    full = next(n for name, n in license_scan.TEMPLATES if name == "BSD-3-Clause" and len(n) > 1000)

    def hurt(share):
        return " ".join(w for w in full.split() if rng.random() >= share)

    rows = [(1, f"{full}\n" * 40), (2, "\n".join(hurt(0.05) for _ in range(40))), (3, "\n".join(hurt(0.12) for _ in range(40))), (4, ("filler words here " * 3000 + full) * 3)]
    got = {(r.doc_id, r.license): (r.score, r.n_units) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "BSD-3-Clause"] == (1.0, 40) and got[1, "BSD-2-Clause"][1] == 40 and got[4, "BSD-3-Clause"] == (1.0, 3)
    assert 38 <= got[2, "BSD-3-Clause"][1] <= 42 and got[3, "BSD-3-Clause"][1] <= 42
    few = [(1, f"{full}\n{full}\nand more"), (2, f"x y z {hurt(0.04)} {'w ' * 300}{hurt(0.03)}"), (None, full.replace("binary", "very old binary")), (3, "Licensed under the MIT License")]
    compare(license_scan.scan(spark.createDataFrame(few, "doc_id long, text string")).toPandas(), duck([(*r, None) for r in few]).execute(queries.ORACLES["op8_license_scan"]).df())


def test_license_scan_odd_rows(spark, odd, empty):
    compare(license_scan.scan(odd).toPandas(), duck().execute(queries.ORACLES["op8_license_scan"]).df())
    assert license_scan.scan(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(odd, [("X", "a b c")] * 3000)


def test_notices_inside_longer_texts(spark):
    """A wrapped notice in a source file, one inside a longer line, a whole licence text, and words that only look like one."""
    import textwrap

    full = next(n for name, n in license_scan.TEMPLATES if name == "MIT" and n.count("\n") > 1)
    wrapped = "\n".join(" * " + line for line in textwrap.wrap("Copyright (c) 2020 Somebody. " + full, 76))
    rows = [
        (1, f"/*\n{wrapped}\n */\nint main() {{ return 0; }}\n"), (2, "Copyright 2020 X. All rights reserved. Printed here."), (3, "word " * 5000 + full.replace("dealings", "doings") + " tail" * 5000),
        (4, "The licence of software is a right that is reserved for all of us."), (5, "Permission is hereby granted to nobody."), (None, full), (None, full),
        (6, "x x x This work is licensed, as a whole, under the GNU General Public License, version 3. y y y"), (7, "x x x This work is licensed under GNU General Public License, version 3. y y y"),
    ]
    got = {(r.doc_id, r.license): r.score for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"] == 1.0 and got[2, "All-Rights-Reserved"] == 1.0 and 0.9 < got[3, "MIT"] <= 1.0 and got[None, "MIT"] == 1.0
    assert got[6, "GPL-3.0"] >= 0.8 and got[7, "GPL-3.0"] >= 0.8
    assert not any(i in (4, 5) for i, _ in got)
    con = duck([(i, t, None, 0) for i, t in rows])
    compare(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas(), con.execute(queries.ORACLES["op8_license_scan"]).df())


def test_every_template_has_more_anchors_than_a_match_may_miss():
    _, rows = license_scan.anchors()
    for _, notice in license_scan.TEMPLATES:
        w = license_scan._words(notice)
        own = set(zip(w, w[1:], strict=False))
        held = {tuple(gram.split()) for t, gram, *_ in rows if t == " ".join(w)}
        assert held <= own and len(held) > len(own) - len(own) * 0.8 / 1.2


def test_decontamination_odd_rows(spark, odd, empty):
    import pandas as pd

    items = [(1, "Job 17 took 4 s on host x9, plain words"), (2, None), (3, "!!"), (4, "CAT sat"), (4, "CAT sat"), (5, "word word word word word word word word word word word"), (6, "plain")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = duck(benchmark=pd.DataFrame(items, columns=["item_id", "text"])).execute(queries.ORACLES["op10_benchmark_decontamination"]).df()
    keyed = lambda df: df[df.doc_id.notna()].drop_duplicates().reset_index(drop=True)  # noqa: E731  SQL joins by id, which repeated and null ids can't
    hits = decontam.contamination(odd, frame, slop=decontam.SLOP)
    compare(keyed(decontam.digest(hits).toPandas()), keyed(want))
    small = decontam.contamination(odd, frame, slop=decontam.SLOP, shard_bytes=40)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(small) == same(hits)
    for r in hits.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
    clean = decontam.clean_documents(odd, frame)
    assert clean.columns == odd.columns and clean.count() == hits.where("n_hit = 0 AND size(near_items) = 0").count()
    assert decontam.contamination(empty, frame).count() == 0 and decontam.contamination(odd, frame.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma far far far far far alpha beta"), (3, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r.items, r.near_items) for r in decontam.contamination(docs, items, window=3, slop=1).collect()}
    assert [r.near_items for r in decontam.contamination(docs, items, slop=1).collect()] == [[]] * 3  # too short for a full window
    assert got == {1: ([], [9]), 2: ([], []), 3: ([9], [9])}


def test_phrases_and_proximity_against_plain_search(spark):
    """Windows of 4 terms over random texts of few words, with repeated and null ids."""
    import random

    r = random.Random(8)
    word = lambda k: [r.choice("abcdefgh") for _ in range(k)]
    docs = [(r.choice([None, i, i // 2]), " ".join(word(r.randint(0, 30)))) for i in range(60)]
    items = [(r.choice([None, i]), " ".join(word(r.randint(1, 6)))) for i in range(12)]
    want = []
    for i, t in docs:
        w, hit, exact, near = t.split(), set(), set(), set()
        for item, q in items:
            q = q.split()
            for s in range(max(1, len(q) - 3)):
                part = q[s : s + 4]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        exact.add(item)
                if len(part) == 4 and any(all(any(w[p] == x for p in range(max(0, at + k - 1), min(len(w), at + k + 2))) for k, x in enumerate(part)) for at in range(-1, len(w) + 1)):
                    near.add(item)
        listed = lambda x: sorted(x, key=lambda v: (v is None, v or 0))
        want.append(str((i, len(w), len(hit), listed(exact), listed(near))))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, slop=1, shard_bytes=200)
    assert sorted(str((x.doc_id, x.n_words, x.n_hit, x["items"], x.near_items)) for x in got.collect()) == sorted(want)
    assert any("[]" not in x for x in want)


def test_chat_parts_round_trip(spark):
    rows = [
        (1, 2, "assistant", [("text", "see <image:1.1> & </turn> \\### ok", None, None), ("image", None, "img://a", 2), ("audio", None, "snd://b", 10)]),
        (1, 1, "user", [("document", None, "doc://c", None), ("odd", "kept as text", None, None)]), (1, 1, "user", [("text", "tie", None, None)]),
        (1, None, None, None), (2, 1, "assistant", []), (None, 1, "user", [("text", "a\nb", None, None)]), (None, 1, "user", [("text", "a\nb", None, None)]),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:long>>").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_conversations(frame).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    one = got[1]
    assert [(b.role, b.body) for b in one.back] == [("", ""), ("user", "<document:1.0>kept as text"), ("user", "tie"), ("assistant", "see <image:1.1> & </turn> \\### ok<image:2.1><audio:2.2>")]
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in one.attachments] == [(1, 0, "document", "doc://c", 512), (2, 1, "image", "img://a", 512), (2, 2, "audio", "snd://b", 250)]
    assert one.attachment_tokens == 1274
    for r in got.values():
        for t in r.turns:
            assert r.formatted[t.start + t.length :].startswith("</turn>") and r.formatted[t.start - 1] == ">" and t.loss == (t.role == "assistant")
    assert len(got[None].back) == 2 and chat.format_conversations(frame.limit(0)).count() == 0


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x in set(windows) if windows[:50].count(x) > 1}
    covered = set()
    for i, x in enumerate(windows):
        if x in often:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        model = {"emission": rng.normal(size=(2, quality.FEATURES)), "transition": rng.normal(size=(2, 2)), "start": rng.normal(size=2)}
        x = rng.normal(size=(n, quality.FEATURES))
        score = x @ model["emission"].T
        value = lambda y: model["start"][y[0]] + sum(score[k, y[k]] for k in range(n)) + sum(model["transition"][a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        best = max(product((0, 1), repeat=n), key=value)
        assert quality.decode(x, np.array([0, n]), model).astype(int).tolist() == list(best)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    compare(queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.ORACLES[name]).df())

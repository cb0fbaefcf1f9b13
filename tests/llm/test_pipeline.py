"""The pipeline stage by stage against brute force, on each stage's own input."""

from __future__ import annotations

import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no corpus_pipeline", allow_module_level=True)

import re

import corpus_pipeline
from barloom.llm import quality
from tests.llm.test_near_stage import kept as all_pairs


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs.collect(), out.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out

    before, after = seen["quality rules"]
    model = quality.train(spark.createDataFrame(before), spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r.doc_id for r in quality.score_documents(spark.createDataFrame(before), model).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and 0 < len(after) < len(before)

    before, after = seen["line dedup"]
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        lines = iter(texts[r.doc_id].split("\n"))
        assert all(line in lines for line in r.text.split("\n")) and r.n_chars == len(r.text)

    before, after = seen["near duplicates"]
    assert sorted((r.doc_id for r in after), key=str) == all_pairs([(r.doc_id, r.text) for r in before])

    before, after = seen["benchmark decontamination"]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = word(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(x) for x in windows}
    dirty = lambda t: any(tuple(w[i : i + n]) in windows for w in [word(t)] for n in sizes for i in range(len(w) - n + 1))
    full = [x for x in windows if len(x) == 10]
    places = lambda w: {t: [i for i, x in enumerate(w) if x == t] for t in set(w)}

    def near(t: str) -> bool:
        at = places(word(t))
        stands = lambda x, s: all(any(abs(p - s - k) <= 1 for p in at[t]) for k, t in enumerate(x))
        return any(all(t in at for t in x) and any(stands(x, p + d) for p in at[x[0]] for d in (-1, 0, 1)) for x in full)

    assert [r.doc_id for r in sorted(after)] == [r.doc_id for r in sorted(before) if not dirty(r.text) and not near(r.text)]

    before, after = seen["source mix"]
    assert len(after) == len(before)
    for source in {r.source for r in after}:
        own = [r for r in after if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target) and all(0 <= r.taken <= 2 * r.size for r in own)


def test_run_returns_the_last_stage(spark, data):
    assert set(corpus_pipeline.run(spark, data).columns) >= {"doc_id", "size", "taken"}

"""What the pipeline leaves on disk or shuffles: earlier stages' outputs, whole texts, lone keys, positions."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from barloom.llm import chunks, decontam, jaccard
from barloom.llm.session import shared_folder


def names(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in files.listStatus(place)}


def test_only_the_last_output_stays(spark, data):
    before = names(spark, shared_folder(spark))
    rows = corpus_pipeline.run(spark, data).count()
    new = names(spark, shared_folder(spark)) - before
    (own,) = (x for x in new if x.startswith("pipeline-"))
    assert names(spark, f"{shared_folder(spark)}/{own}") == {"4"} and rows > 0
    assert not [x for x in new if x.startswith("index-") and not x.endswith("-hits")]


def test_texts_are_not_shuffled_to_drop_copies(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven " + "x" * (i // 2)) for i in range(6)], "doc_id long, text string")
    kept = jaccard.keep_one(docs)
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_keys_of_one_document_are_not_sent_whole(spark, monkeypatch):
    """Of 40 unlike documents and two near copies, only the copies' keys and chance hits are asked for with their owners."""
    rng = np.random.default_rng(5)
    text = [" ".join(map(str, rng.integers(0, 10**9, 300))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(text), (40, text[0] + " more")], "doc_id long, text string")
    sent, inner = [], chunks.answer
    monkeypatch.setattr(jaccard.chunks, "answer", lambda requests, reply: inner(sent.append(requests) or requests, reply))
    monkeypatch.setattr(chunks, "LEAST_BYTES", 1 << 12)
    found = jaccard.candidate_sets(docs, 80, 5)
    assert found.where("body is not null").count() == 2
    size = [r.selectExpr("sum(octet_length(body)) as b").first().b for r in sent]
    assert len(size) == 2 and size[1] < size[0] / 2


def test_gaps():
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(1 << bits, min(n, 1 << bits), replace=False)) for bits, n in ((1, 2), (7, 9), (14, 3000), (22, 5), (40, 77), (3, 1))]
    n = np.array([len(x) for x in lists])
    values = np.concatenate(lists)
    data, cut = decontam.gaps(values, np.cumsum(n) - n)
    assert decontam.ungap(data, n).tolist() == values.tolist()
    assert [decontam.ungap(data[i:j], n[k : k + 1]).tolist() for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))] == [x.tolist() for x in lists]
    assert len(data) < 2 * len(values) + 6 * 77

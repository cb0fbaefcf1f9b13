"""Benchmark items of null id, against SQL."""

from __future__ import annotations

import pandas as pd

from barloom.llm import decontam, queries
from tests.llm.test_edges import SCHEMA, duck
from tests.test_queries import compare

DOCS = [(1, "one two three four", "a", 1), (2, "five six seven eight", "a", 1), (3, "nothing here", "a", 1), (4, "one two three five six seven", "a", 1)]
ITEMS = [(None, "one two three"), (7, "five six seven"), (None, "seven eight")]


def test_windows_of_null_items_count(spark):
    docs, items = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    frame = pd.DataFrame({"item_id": pd.array([i for i, _ in ITEMS], "Int64"), "text": [t for _, t in ITEMS]})
    want = duck(DOCS, benchmark=frame).execute(queries.ORACLES["op10_benchmark_decontamination"]).df()
    compare(decontam.digest(decontam.contamination(docs, items, slop=decontam.SLOP)).toPandas(), want)
    assert [r.doc_id for r in decontam.clean_documents(docs, items).collect()] == [3]
    shards = decontam.digest(decontam.contamination(docs, items, slop=decontam.SLOP, shard_bytes=30))
    compare(shards.toPandas(), want)

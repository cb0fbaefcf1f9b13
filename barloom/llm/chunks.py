"""Asking all documents about a key, with one request for each key and group of documents.

Documents are dealt into chunks by a hash of their id and text, so rows of one id or of null ids
spread as well; documents of one id may lie in several chunks. A chunk sends each distinct key once,
with what it knows about it, to the key's bucket; buckets answer chunks. However many rows hold
a key, a bucket gets at most one request for it from each chunk, so no key makes a hot task.
The texts cross the network once, compressed in packets of a task's documents for a chunk; later
steps reuse that exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textkit import U64

PARCEL = "bucket int, chunk int, kind int, body binary"
"""A parcel from a chunk to a bucket or back. kind is the caller's own."""

CHUNK_BYTES = 6 << 20
"""Text in a chunk, on average; bounds the memory of a task."""
MOST_CHUNKS, MOST_BYTES = 4096, 64 << 20
"""Beyond so many chunks they grow, to so many bytes, which keeps the parcels between chunks and buckets large."""
LEAST_BYTES = 1 << 17
"""Small inputs are cut into as many chunks as there are shuffle partitions, but not into smaller ones than this."""


PACKET_BYTES = 32 << 20
"""Text that a task gathers before it sends packets."""
TYPES = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}


@dataclass
class Texts:
    """Packets of documents by chunk, and the columns in them."""

    packets: DataFrame
    schema: pa.Schema


def opened(packets: pa.Table, schema: pa.Schema) -> pa.Table:
    """The documents of one chunk."""
    codec, batches = pa.Codec("zstd"), []
    for body in packets["body"]:
        data = body.as_buffer()
        size = int.from_bytes(data.slice(0, 8).to_pybytes(), "little")
        batches.append(pa.ipc.read_record_batch(codec.decompress(data.slice(8), size), schema))
    return pa.Table.from_batches(batches, schema)


def deal(docs: DataFrame, columns: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> tuple[Texts, int]:
    """docs (doc_id, text and the columns named) with the number of their chunk, and how many chunks there are."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(chunk_bytes, min(MOST_BYTES, total // MOST_CHUNKS))
    n = max(1, math.ceil(total / size), min(partitions, math.ceil(total / LEAST_BYTES)))
    key = F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(n))
    dealt = docs.select(F.pmod(key, F.lit(n)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text", *(columns or []))
    kinds = dict(dealt.dtypes)
    schema = pa.schema([("chunk", pa.int32()), *((c, TYPES[kinds[c]]) for c in dealt.columns[1:])])

    def send(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).cast(schema)
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        table, chunk = table.take(pa.array(order)).combine_chunks(), chunk[order]
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        codec, bodies = pa.Codec("zstd", 3), []
        batch = table.to_batches()[0]
        for i, j in zip(first, np.r_[first[1:], len(chunk)], strict=True):
            data = batch.slice(i, j - i).serialize()
            bodies.append(data.size.to_bytes(8, "little") + codec.compress(data, asbytes=True))
        yield pa.record_batch({"chunk": pa.array(chunk[first]), "body": pa.array(bodies, pa.binary())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACKET_BYTES:
                yield from send(held)
                held, size = [], 0
        if sum(map(len, held)):
            yield from send(held)

    return Texts(dealt.mapInArrow(work, "chunk int, body binary"), schema), n


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the key, so sorted keys lie bucket by bucket."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def parcels(keys: np.ndarray, buckets: int, chunk: int, kind: int, body: Callable[[slice], bytes]) -> Iterator[tuple]:
    """One parcel for each bucket that has any of the sorted keys."""
    if not len(keys):
        return
    place = bucket_of(keys, buckets)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    for i, j in zip(first, np.r_[first[1:], len(place)], strict=True):
        yield int(place[i]), chunk, kind, body(slice(int(i), int(j)))


def parcel_table(rows: list[tuple]) -> pa.Table:
    bucket, chunk, kind, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary())})


def first_step(texts: Texts, ask: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """Requests of every chunk."""
    packets, schema = texts.packets, texts.schema
    return packets.groupBy("chunk").applyInArrow(lambda t: parcel_table(ask(opened(t, schema))), PARCEL)


def answer(requests: DataFrame, reply: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """Answers of every bucket to the requests that it got."""
    return requests.groupBy("bucket").applyInArrow(lambda t: parcel_table(reply(t)), PARCEL)


def next_step(texts: Texts, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str = PARCEL) -> DataFrame:
    """Each chunk with the answers to it."""
    packets, columns = texts.packets, texts.schema
    return packets.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: work(opened(t, columns), a), schema)


def bodies(table: pa.Table, kind: int | None = None) -> list[tuple[int, int, bytes]]:
    """(bucket, chunk, body) of the parcels of a kind, by bucket and chunk."""
    rows = zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), table["kind"].to_pylist(), table["body"].to_pylist(), strict=True)
    return sorted((b, c, body) for b, c, k, body in rows if kind is None or k == kind)

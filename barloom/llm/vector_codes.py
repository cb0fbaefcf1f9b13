"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, in integers throughout.

Parts and entries are padded with zeros to a power of two and go through the integer Walsh-Hadamard
transform, which multiplies every squared distance by the padded length. Squared differences of the
coefficients are added in sequency order (by number of sign changes), so what has been added is a
lower bound: an entry that stands above the whole distance of the most promising one is out.
Survivors are compared by whole sums, ties to the lower index, so the codes are exact.

A training round is one pass: a task adds up its parts by entry, and Spark adds the tasks' sums, cut
into limbs of 40 bits that no number of tasks overflows. Codebooks have parts x entries x width numbers,
as many for any input; they are all that the driver holds.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; a null
vec_id is larger than any other, rows of one vec_id are ordered by their vectors; a vector shorter than the longest
one is filled with zeros, and so are all up to a multiple of the number of parts; fewer rows than entries give fewer entries;
an empty table gives an empty result; an error beyond 64 bits is null, and so are sums with such an error.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.keyed import join_totals
from barloom.scratch import scratch_folder

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 4096
"""Vectors that a task compares at once."""
LIMB = 40


def finite(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector and components are all there and finite; the vector as doubles."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(column).isNotNull() & ~bad).withColumn(column, v)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as Python integers if one of them needs more than 62 bits."""
    if not len(values) or np.abs(values).max() < 2.0**54:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**54 else int(np.floor(x * SCALE)) for x in values], object)


def sequency(size: int) -> np.ndarray:
    """For each number of sign changes, the place of that row in the transform of a power of two."""
    bits, s = size.bit_length() - 1, np.arange(size)
    gray, out = s ^ (s >> 1), np.zeros(size, np.int64)
    for b in range(bits):
        out |= (gray >> b & 1) << (bits - 1 - b)
    return out


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """The transform of rows of a power of two, coefficients in sequency order."""
    n, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return rows[:, sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, for each row of parts."""
    (n, width), k = parts.shape, len(entries)
    size = 1 << max(0, width - 1).bit_length()
    most = max((int(np.abs(x).max()) for x in (parts, entries) if x.size), default=0)
    kind = np.int64 if (2 * most * size) ** 2 * size * k < 2**62 else object
    padded = [np.zeros((len(x), size), kind) for x in (parts, entries)]
    for to, x in zip(padded, (parts, entries), strict=True):
        to[:, :width] = x
    a, b = (walsh_hadamard(x) for x in padded)
    first = (a[:, :1] - b[None, :, 0]) ** 2
    guess = np.argmin(first, 1)
    bound = ((a - b[guess]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for i in range(1, size):
        total = total + (a[row, i] - b[entry, i]) ** 2
        stay = total <= bound[row]
        row, entry, total = row[stay], entry[stay], total[stay]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, np.int64)
    best = np.minimum.reduceat(total * k + entry, start) if n else np.zeros(0, kind)
    return (best % k).astype(np.int64), best // k // size


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of integers, filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = integers(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width), values.dtype)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            part = batch.slice(i, BLOCK)
            yield part, matrix(part.column("embedding"), width)


def limbs(values: np.ndarray) -> list[list[int]]:
    """Digits of 40 bits, the last one signed."""
    out, rest = [], [int(v) for v in values]
    while any(abs(v) >> LIMB for v in rest):
        out.append([v & (1 << LIMB) - 1 for v in rest])
        rest = [v >> LIMB for v in rest]
    return [*out, rest]


def summed(books: list[np.ndarray], width: int):
    """What a task adds up: (part, entry, limb, n, sums) of its vectors."""
    step = width // len(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for _, x in blocks(batches, width):
            for p, book in enumerate(books):
                own = x[:, p * step : (p + 1) * step]
                code, _ = nearest(own, book)
                counts[p] += np.bincount(code, minlength=len(book))
                add = np.zeros(book.shape, own.dtype if len(own) and own.dtype == object or np.abs(own).max(initial=0) < 2**40 else object)
                np.add.at(add, code, own)
                sums[p] = sums[p] + add
        rows = [(p, e, k, int(n) if k == 0 else 0, digits) for p in range(len(books)) for e, n in enumerate(counts[p]) if n for k, digits in enumerate(limbs(sums[p][e]))]
        names = ("part", "entry", "limb", "n", "sums")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return work


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks of the parts, and the width of the vectors with their zeros. rows as finite() gives them; no rows: no codebooks."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return [], 0
    width = -(-longest // parts) * parts
    step = width // parts
    seeds = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = matrix(pa.array([r.embedding for r in seeds], pa.list_(pa.float64())), width)
    books = [start[:, p * step : (p + 1) * step] for p in range(parts)]
    for _ in range(rounds):
        found = rows.select("embedding").mapInArrow(summed(books, width), "part int, entry int, limb int, n long, sums array<long>")
        place = F.posexplode("sums").alias("at", "s") if step else F.expr("posexplode(array(0L)) AS (at, s)")
        sums = found.select("part", "entry", "limb", "n", place).groupBy("part", "entry", "limb", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        counts, whole = {}, {}
        for r in sums:
            counts[r.part, r.entry] = max(r.n, counts.get((r.part, r.entry), 0))
            whole[r.part, r.entry, r.at] = whole.get((r.part, r.entry, r.at), 0) + (r.s << LIMB * r.limb)
        new = [b.astype(object) for b in books]
        for (p, e, i), s in whole.items():
            if i < step:
                new[p][e, i] = s // counts[p, e]
        books = [b.astype(np.int64) if not b.size or max(abs(v) for v in b.flat) < 2**62 else b for b in new]
    return books, width


def coded(books: list[np.ndarray], width: int):
    """vec_id, label, code and error of a task's vectors."""
    step = width // max(1, len(books))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, width):
            found = [nearest(x[:, p * step : (p + 1) * step], book) for p, book in enumerate(books)]
            code = np.stack([c for c, _ in found], 1)
            error = sum(d.astype(object) if d.dtype == object or len(d) and d.max() >= 2**62 // len(books) else d for _, d in found)
            text = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            fits = pa.array([int(e) if e < 2**63 else None for e in error.tolist()], pa.int64())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), fits], ["vec_id", "label", "code", "error"])

    return work


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and the digest of the codebooks, for each finite vector of (vec_id, embedding, label)."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    spark, kept = rows.sparkSession, finite(rows.select("vec_id", "embedding", "label"))
    books, width = train(kept, parts, entries, rounds)
    kinds = dict(kept.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not books:
        return spark.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    place = scratch_folder(spark, "codes")
    kept.mapInArrow(coded(books, width), schema).write.parquet(place)
    codes = spark.read.parquet(place)
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_sum(error)"))
    totals = codes.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), whole.alias("label_error"))
    return join_totals(codes, totals, ["label"], "_n").withColumn("codebooks_sha256", F.lit(digest_of(books)))

"""Small numpy helpers that run inside Spark tasks: word spans, fingerprints and packed columns.

All functions work on the bytes of a run of documents at once, so Python never loops over
words. Fingerprints are polynomial sums modulo 2**64 followed by a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
NO_ID = np.iinfo(np.int64).max
"""Stands for a null document id: larger than any other, so it never is the first copy."""

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
NOT_TERM = np.ones(256, bool)
NOT_TERM[0x30:0x3A] = NOT_TERM[0x61:0x7B] = NOT_TERM[0x80:] = False

_BASE = 0x9E3779B97F4A7C15 // 8 * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _tables[base] = np.multiply.accumulate(have)
    return _tables[base][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ U64(salt * 0xD6E8FEB86659FD93 % 2**64)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins (one more entry than texts); null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Document ids as int64; null: NO_ID."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def ranks_of(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order; negative ones too."""
    return ids.astype(U64) ^ U64(1 << 63)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def runs(off: np.ndarray, limit: int = 1 << 20):
    """Runs i:j of documents with at most limit bytes together; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j
        i = j


def words(buf: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word's number for each document (one more entry than documents)."""
    inside = ~separator[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fingerprint of values[start:end] for each span."""
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * _powers(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(U64), salt)


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(_BYTES[buf], starts, ends)


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """All positions at which a window of that size fits into its document."""
    n = np.diff(bounds)
    at = np.arange(bounds[-1])
    return at[at + size <= np.repeat(bounds[1:], n)]


def cover(n: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Of n positions, which lie in [start, start + size) of any start."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned numbers, plane by plane: planes of equal bytes compress to nothing."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place in sorted_keys, and whether it is there (the place of a key that isn't there means nothing)."""
    at, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    if not len(sorted_keys):
        return at, there
    bits = max(16, (16 * len(sorted_keys)).bit_length())
    if bits <= 24 and len(keys) >> (bits - 3):
        low = U64((1 << bits) - 1)
        table = np.zeros(1 << bits, bool)
        table[sorted_keys & low] = True
        here = np.flatnonzero(table[keys & low])
    else:
        here = slice(None)
    place = np.minimum(np.searchsorted(sorted_keys, keys[here]), len(sorted_keys) - 1)
    at[here], there[here] = place, sorted_keys[place] == keys[here]
    return at, there


def heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)

"""Substring dedup on words with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window, and all rolling
windows of that size probe the index of blocks. Any repeated window of 50 words holds a whole
reference block of each document in which it stands, so both places are found. Hits are then
extended: around each hit, the 50-word windows that hold it are compared by a 96-bit
fingerprint, and overlapping ones that also start in a smaller document merge into the maximal
exact repeats that are removed.

Chunks of documents ask about keys (see chunks.py): once for each key and chunk, so neither
copies nor common passages make a hot task, and no pair of documents is ever formed.

Defined cases: null or empty text has no words; a null document id is larger than any other;
equal ids count as one document; repeated rows are returned once each; documents shorter than a
window keep all words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm import chunks
from barloom.llm.textkit import SPACE, U64, cover, heads, ids_back, ids_of, member, pack, ranks_of, runs, span_hash, texts_of, unpack, window_starts, word_hash, words

WINDOW = 50
KEY = 5
"""Bytes of a block's fingerprint beside its bucket; a false hit is only compared in vain."""
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _pieces(table: pa.Table):
    """Runs of a chunk's documents: row numbers, ids, bytes, offsets, word bounds and word fingerprints."""
    buf, off = texts_of(table["text"])
    ids = ids_of(table["doc_id"])
    for i, j in runs(off):
        part, cut = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, bounds = words(part, cut, SPACE)
        yield i, ids[i:j], part, cut, bounds, word_hash(part, starts, ends)


def _per_key(keys: tuple[np.ndarray, ...], ids: np.ndarray, flags: np.ndarray | None = None):
    """Distinct keys in order, each with its least and largest id and all its flags."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = heads(*keys)
    at = lambda f, x: f.reduceat(x[order], first) if len(first) else x[:0]
    return tuple(k[first] for k in keys), at(np.minimum, ids), at(np.maximum, ids), None if flags is None else at(np.bitwise_or, flags)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every document: words, words removed, a digest of the rest, and the removed spans (in words, end excluded)."""
    block = window // 2
    texts, n = chunks.deal(docs)
    low = U64((1 << 8 * KEY) - 1)

    def near(keys: np.ndarray) -> np.ndarray:
        return chunks.bucket_of(keys, n).astype(U64) << U64(8 * KEY) | keys & low

    def ask(table: pa.Table) -> list[tuple]:
        found = []
        for _, ids, _, _, bounds, h in _pieces(table):
            at = window_starts(bounds, block)
            inside = at - np.repeat(bounds[:-1], np.diff(bounds))[at]
            key = span_hash(h, at, at + block, 1)
            found.append((key, np.repeat(ids, np.diff(bounds))[at], (inside % block == 0).astype(np.uint8)))
        if not found:
            return []
        (key,), least, most, is_block = _per_key((np.concatenate([f[0] for f in found]),), *(np.concatenate([f[k] for f in found]) for k in (1, 2)))
        flags = (is_block | (least != most).astype(np.uint8) << 1).astype(U64)
        # A chunk's own document numbers need not be sent: keys of different chunks stand in different documents.
        return list(chunks.parcels(key, n, int(table["chunk"][0].as_py()), 0, lambda s: pack(key[s], KEY) + pack(flags[s], 1)))

    def hits(table: pa.Table) -> list[tuple]:
        got = chunks.bodies(table)
        sizes = [len(b) // (KEY + 1) for _, _, b in got]
        key = np.concatenate([unpack(b[: m * KEY], KEY) for (_, _, b), m in zip(got, sizes, strict=True)])
        flags = np.concatenate([np.frombuffer(b[m * KEY :], np.uint8) for (_, _, b), m in zip(got, sizes, strict=True)])
        order = np.argsort(key, kind="stable")
        first = heads(key[order])
        size = np.diff(np.r_[first, len(key)])
        every = np.bitwise_or.reduceat(flags[order], first)
        hit = np.empty(len(key), bool)
        hit[order] = np.repeat((every & 1 > 0) & ((size > 1) | (every & 2 > 0)), size)
        cuts = np.r_[0, np.cumsum(sizes)]
        return [(b, c, 0, pack(k, KEY)) for (b, c, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True) if len(k := key[i:j][hit[i:j]])]

    def windows(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return span_hash(h, at, at + window, 2), span_hash(h, at, at + window, 3) & U64(0xFFFFFFFF)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        got = chunks.bodies(answers)
        if not len(table) or not got:
            return chunks.parcel_table([])
        wanted = np.sort(np.concatenate([U64(b << 8 * KEY) | unpack(body, KEY) for b, _, body in got]))
        found = []
        for _, ids, _, _, bounds, h in _pieces(table):
            at = window_starts(bounds, block)
            _, hit = member(wanted, near(span_hash(h, at, at + block, 1)))
            at, doc = at[hit], np.repeat(np.arange(len(ids)), np.diff(bounds))
            begin = np.maximum(at - (window - block), bounds[doc[at]])
            mark = cover(len(h), begin, at + 1 - begin)
            at = window_starts(bounds, window)
            at = at[mark[at]]
            found.append((*windows(h, at), ids[doc[at]]))
        keys, least, most, _ = _per_key(tuple(np.concatenate([f[k] for f in found]) for k in (0, 1)), np.concatenate([f[2] for f in found]))
        key, more = keys
        least, most = ranks_of(least), ranks_of(most)
        body = lambda s: pack(key[s], 8) + pack(more[s], 4) + pack(least[s], 8) + pack(least[s] ^ most[s], 8)
        return chunks.parcel_table(list(chunks.parcels(key, n, int(table["chunk"][0].as_py()), 0, body)))

    def earlier(table: pa.Table) -> list[tuple]:
        got = chunks.bodies(table)
        sizes = [len(b) // 28 for _, _, b in got]
        column = lambda i, j: np.concatenate([unpack(b[i * m : j * m], j - i) for (_, _, b), m in zip(got, sizes, strict=True)])
        key, more, least, most = column(0, 8), column(8, 12), column(12, 20), column(20, 28)
        most = most ^ least
        order = np.lexsort((more, key))
        first = heads(key[order], more[order])
        smallest = np.empty(len(key), U64)
        smallest[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.r_[first, len(key)]))
        cuts = np.r_[0, np.cumsum(sizes)]
        out = []
        for (b, c, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True):
            take = i + np.flatnonzero(smallest[i:j] < most[i:j])
            if len(take):
                out.append((b, c, 0, pack(key[take], 8) + pack(more[take], 4) + pack(smallest[take], 8)))
        return out

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        got = [b for _, _, b in chunks.bodies(answers)]
        column = lambda i, j: np.concatenate([unpack(b[i * (len(b) // 20) : j * (len(b) // 20)], j - i) for b in got] or [np.zeros(0, U64)])
        key, more, smallest = column(0, 8), column(8, 12), column(12, 20)
        order = np.lexsort((more, key))
        key, more, smallest = key[order], more[order], smallest[order]
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        for _, ids, part, cut, bounds, h in _pieces(table):
            doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
            at = window_starts(bounds, window)
            gone = np.zeros(len(h), bool)
            if len(key):
                own, rest = windows(h, at)
                place, there = member(key, own)
                # Keys that agree in 64 bits may differ in the other 32: step on to the equal pair.
                place, at, own, rest = np.searchsorted(key, own[there]), at[there], own[there], rest[there]
                while True:
                    step = (place < len(key)) & (key[np.minimum(place, len(key) - 1)] == own) & (more[np.minimum(place, len(key) - 1)] < rest)
                    if not step.any():
                        break
                    place = place + step
                place = np.minimum(place, len(key) - 1)
                same = (key[place] == own) & (more[place] == rest) & (smallest[place] < ranks_of(ids[doc[at]]))
                gone = cover(len(h), at[same], window)
            text = part.tobytes()
            sums = np.r_[0, np.cumsum(gone)]
            for k in range(len(ids)):
                a, b = int(bounds[k]), int(bounds[k + 1])
                tokens = text[cut[k] : cut[k + 1]].split()
                removed = int(sums[b] - sums[a])
                spans = []
                if removed:
                    lit = np.flatnonzero(gone[a:b])
                    head = heads(lit - np.arange(len(lit)))
                    spans = [{"start": int(x), "end": int(y) + 1} for x, y in zip(lit[head], lit[np.r_[head[1:], len(lit)] - 1], strict=True)]
                    tokens = compress(tokens, (~gone[a:b]).tolist())
                out["n_words"].append(b - a)
                out["n_removed"].append(removed)
                out["kept_sha256"].append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                out["spans"].append(spans)
            out["doc_id"].append(ids)
        ids = np.concatenate(out["doc_id"]) if out["doc_id"] else np.zeros(0, np.int64)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": ids_back(ids), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "spans": pa.array(out["spans"], span)})

    found = chunks.answer(chunks.first_step(texts, ask), hits)
    found = chunks.answer(chunks.next_step(texts, found, extend), earlier)
    return chunks.next_step(texts, found, finish, RESULT)

"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Base rules reject documents that are too short or repeat themselves. Of the others, Viterbi
decoding labels each line that has a word; a document stays if enough of its words stand in
content lines. The field is fitted on a bounded sample of labelled documents, then applied to all
rows in one pass without a shuffle. Labels tell only a document's quality, so the labels of its
lines are latent: they are decoded again and again under the constraint that content holds the
majority of words in good documents and not in bad ones, so a document may hold both kinds.

Defined cases: null text counts as empty; an empty text has no words and fails the base rules;
null ids are passed through; repeated rows are judged alike; columns besides doc_id and text are
ignored by score_documents() and kept by filter_documents(). Without labels of both kinds the
field keeps all that passes the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.textkit import SPACE, cover, heads, mix, runs, span_hash, texts_of, window_starts, word_hash, words
from barloom.llm.textkit import _BYTES as BYTE_VALUES

SAMPLE_DOCS = 2000
"""At most so many labelled documents are used to fit the field."""
PIECE_LINES = 32
"""A sampled document is cut into training sequences of so many lines; all its lines are used."""
FIT_DOCS, FIT_BYTES = 250, 4 << 20
"""Sampled documents and bytes of text in a task that fits the field."""
ROUNDS, STEPS = 3, 60
"""Turns of labelling lines and fitting; gradient steps in each."""
CONTENT_SHARE = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50

SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?'\"()-")] = True
FEATURES = 11


def measure(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts by document; then, for lines that have a word, their features, their number of words, and the first line of each document (one more entry)."""
    n_docs = len(off) - 1
    starts, ends, bounds = words(buf, off, SPACE)
    n_words = np.diff(bounds)
    total = lambda x: np.r_[0, np.cumsum(x, dtype=np.int64)]
    points, symbols = total((buf & 0xC0) != 0x80), total(SYMBOL[buf])
    word_points = total(points[ends] - points[starts])
    doc_of_word = np.repeat(np.arange(n_docs), n_words)

    hashes = word_hash(buf, starts, ends)
    at = window_starts(bounds, 3)
    key = mix(span_hash(hashes, at, at + 3) ^ mix(doc_of_word[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    repeated = total(cover(len(starts), at[twice], 3))

    edges = np.union1d(off, np.flatnonzero(buf == 10) + 1)
    segment = np.searchsorted(edges, starts, "right") - 1
    first = heads(segment)
    line_words = np.diff(np.r_[first, len(starts)])
    seg, doc = segment[first], doc_of_word[first]
    begin, stop = edges[seg], edges[seg + 1] if len(seg) else edges[:0]
    stop = stop - (buf[stop - 1] == 10) if len(stop) else stop
    line_key = mix(span_hash(BYTE_VALUES[buf], begin, stop) ^ mix(doc.astype(np.uint64)))
    order = np.argsort(line_key, kind="stable")
    dup = np.zeros(len(seg), bool)
    dup[order[1:][line_key[order][1:] == line_key[order][:-1]]] = True

    size = np.maximum(stop - begin, 1)
    share = lambda table: (lambda c: (c[stop] - c[begin]) / size)(total(table[buf]))
    stutter = np.zeros(len(starts), bool)
    stutter[1:] = hashes[1:] == hashes[:-1]
    stutter = total(stutter)
    marked = total(symbols[ends] > symbols[starts])
    last = first + line_words
    x = np.empty((len(seg), FEATURES))
    for k, column in enumerate((
        np.ones(len(seg)), np.log1p(line_words) / 5, share(SYMBOL) * 5, share(UPPER) * 2, share(DIGIT) * 5, share(MARK) * 5, dup,
        (repeated[last] - repeated[first]) / np.maximum(line_words, 1), (stutter[last] - stutter[first]) / np.maximum(line_words, 1),
        (points[stop] - points[begin]) / np.maximum(line_words, 1) / 10, (marked[last] - marked[first]) / np.maximum(line_words, 1),
    )):
        x[:, k] = column
    counts = {
        "n_words": n_words, "word_chars": np.diff(word_points[bounds]), "n_symbols": np.diff(symbols[off]),
        "n_dup_lines": np.bincount(doc[dup], minlength=n_docs), "n_repeat_words": np.diff(repeated[bounds]),
    }
    return counts, x, line_words, np.searchsorted(doc, np.arange(n_docs + 1))


def decode(x: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """Viterbi: the likeliest label (1: content) of each line, each document being one sequence."""
    score = x @ np.asarray(model["emission"]).T
    zero, one = score[:, 0].tolist(), score[:, 1].tolist()
    (stay0, to1), (to0, stay1) = np.asarray(model["transition"]).tolist()
    start0, start1 = np.asarray(model["start"]).tolist()
    labels = np.zeros(len(x), bool)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if i == j:
            continue
        a, b = start0 + zero[i], start1 + one[i]
        back = []
        for k in range(i + 1, j):
            from0, from1 = a + to1 > b + stay1, b + to0 > a + stay0
            back.append((from1, not from0))
            a, b = (b + to0 if from1 else a + stay0) + zero[k], (a + to1 if from0 else b + stay1) + one[k]
        state = b >= a
        labels[j - 1] = state
        for k in range(j - 2, i - 1, -1):
            state = back[k - i][state]
            labels[k] = state
    return labels


def expected(parts: list[np.ndarray], x: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums over padded sequences: log-normaliser, label marginals, and marginals of neighbouring labels."""
    emission, transition, start = parts
    long = x.shape[1]
    e = np.einsum("nlf,cf->lnc", x, emission)
    on = on.T[:, :, None]
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[0] = start + e[0]
    for t in range(1, long):
        moved = np.logaddexp(forward[t - 1, :, :1] + transition[0], forward[t - 1, :, 1:] + transition[1]) + e[t]
        forward[t] = np.where(on[t], moved, forward[t - 1])
    for t in range(long - 2, -1, -1):
        ahead = e[t + 1] + backward[t + 1]
        backward[t] = np.where(on[t + 1], np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1]), 0)
    z = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    seen = np.exp(forward + backward - z[:, None]) * on
    pairs = forward[:-1, :, :, None] + transition + (e[1:] + backward[1:])[:, :, None, :] - z[:, None, None]
    return z, seen.swapaxes(0, 1), np.exp(np.where(on[1:, :, :, None], pairs, -np.inf)).swapaxes(0, 1)


def fit(sequences: list[tuple[np.ndarray, np.ndarray, float]], parts: list[np.ndarray] | None = None, steps: int = STEPS, ridge: float = 1e-3, chained: bool = True) -> list[np.ndarray]:
    """Maximum conditional likelihood of label sequences (features, labels, weight) by gradient ascent; without chained, of emissions alone."""
    pieces = [(x[i : i + PIECE_LINES], y[i : i + PIECE_LINES], w) for x, y, w in sequences for i in range(0, len(x), PIECE_LINES)]
    long = max(len(x) for x, _, _ in pieces)
    x, on, y = np.zeros((len(pieces), long, FEATURES)), np.zeros((len(pieces), long), bool), np.zeros((len(pieces), long), np.int64)
    for k, (rows, labels, _) in enumerate(pieces):
        x[k, : len(rows)], on[k, : len(rows)], y[k, : len(rows)] = rows, True, labels
    weight = np.array([w for _, _, w in pieces])[:, None, None]
    gold = np.eye(2)[y] * on[:, :, None]
    gold_pairs = np.einsum("nlc,nld->cd", gold[:, :-1] * weight, gold[:, 1:])
    parts = [p.copy() for p in parts or (np.zeros((2, FEATURES)), np.zeros((2, 2)), np.zeros(2))]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for step in range(1, steps + 1):
        _, seen, pairs = expected(parts, x, on)
        slope = [np.einsum("nlc,nlf->cf", (gold - seen) * weight, x), gold_pairs - (pairs * weight[..., None]).sum((0, 1)), ((gold - seen)[:, 0] * weight[:, 0]).sum(0)]
        for k, (g, (m, v)) in enumerate(zip(slope, memory, strict=True)):
            if k and not chained:
                continue
            g = g - ridge * parts[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            parts[k] = parts[k] + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return parts


def relabel(x: np.ndarray, n_words: np.ndarray, good: bool, parts: list[np.ndarray]) -> np.ndarray:
    """The likeliest labels of a document's lines among those that give content the majority of words in a good document, and not in a bad one."""
    model = {"emission": parts[0].copy(), "transition": parts[1], "start": parts[2]}
    for push in (0, 0.5, 1, 2, 4, 8, 16):
        model["emission"][:, 0] = parts[0][:, 0] + ([0, push] if good else [push, 0])
        labels = decode(x, np.array([0, len(x)]), model)
        if ((n_words * labels).sum() >= CONTENT_SHARE * n_words.sum()) == good:
            return labels.astype(np.int64)
    return np.full(len(x), int(good))


def fit_documents(documents: list[tuple[np.ndarray, np.ndarray, bool]], rounds: int = ROUNDS) -> list[np.ndarray] | None:
    """Fit the field on documents (features and words of each line, quality), whose line labels are latent.

    Lines start with their document's label and fit the emissions alone; then the labels are
    decoded anew under the document's quality (relabel) and the whole field is fitted to them, in turns.
    """
    n = [max(1, sum(good == k for _, _, good in documents)) for k in (False, True)]
    if not documents or min(sum(good == k for _, _, good in documents) for k in (False, True)) == 0:
        return None
    weights = [0.5 / n[good] for _, _, good in documents]
    labels = [np.full(len(x), int(good)) for x, _, good in documents]
    parts = fit([(x, y, w) for (x, _, _), y, w in zip(documents, labels, weights, strict=True)], chained=False)
    for _ in range(rounds):
        labels = [relabel(x, n_words, good, parts) for x, n_words, good in documents]
        parts = fit([(x, y, w) for (x, _, _), y, w in zip(documents, labels, weights, strict=True)], parts)
    return parts


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Fit the field on at most sample_docs labelled documents, chosen by a hash of their id.

    The sample is dealt into shards of about FIT_DOCS documents and FIT_BYTES of text at most. Each is
    fitted in a task of its own, and the parameters (28 numbers a shard) are averaged by numbers of documents.
    Good and bad documents are dealt apart, so every shard has both; of a kind with fewer documents than
    there are shards each one goes to several. A shard weighs both kinds alike.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).persist()
    n, size = picked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n // FIT_DOCS), -(-size // FIT_BYTES))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        buf, off = texts_of(table["text"])
        quality, documents = table["quality"].to_pylist(), []
        for i, j in runs(off):
            _, x, n_words, first = measure(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            documents += [(x[a:b], n_words[a:b], q == 1) for a, b, q in zip(first[:-1], first[1:], quality[i:j], strict=True) if a < b]
        parts = fit_documents(documents)
        rows = [] if parts is None else [np.concatenate([p.ravel() for p in parts]).tolist()]
        return pa.table({"n": pa.array([len(documents)] * len(rows), pa.int64()), "parts": pa.array(rows, pa.list_(pa.float64()))})

    kind = Window.partitionBy(F.col("quality") == 1)  # of the sample
    ranked = picked.withColumns({"_r": F.row_number().over(kind.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")) - 1, "_n": F.count(F.lit(1)).over(kind).cast("int")})
    places = F.when(F.col("_n") >= shards, F.array(F.col("_r") % shards)).otherwise(F.sequence(F.col("_r"), F.lit(shards - 1), F.col("_n")))
    dealt = ranked.withColumn("shard", F.explode(places)).drop("_r", "_n").repartition(shards, "shard")
    fitted = sorted((r.n, r.parts) for r in dealt.groupBy("shard").applyInArrow(work, "n long, parts array<double>").collect())
    picked.unpersist()
    if not fitted:
        return {"emission": np.zeros((2, FEATURES)), "transition": np.zeros((2, 2)), "start": np.zeros(2), "trivial": True}
    mean = np.average([p for _, p in fitted], axis=0, weights=[n for n, _ in fitted])
    return {"emission": mean[: 2 * FEATURES].reshape(2, FEATURES), "transition": mean[2 * FEATURES : 2 * FEATURES + 4].reshape(2, 2), "start": mean[2 * FEATURES + 4 :], "trivial": False}


def verdicts(buf: np.ndarray, off: np.ndarray, model: dict) -> dict[str, np.ndarray]:
    counts, x, line_words, first = measure(buf, off)
    label = np.ones(len(x), bool) if model["trivial"] else decode(x, first, model)
    sums = np.r_[0, np.cumsum(line_words * label)]
    share = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(counts["n_words"], 1)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
    return counts | {"base_failed": failed, "content_share": share, "kept": ~failed & (share >= CONTENT_SHARE)}


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """Counts, content share and verdict for every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = texts_of(batch["text"])
            for i, j in runs(off):
                out = verdicts(buf[off[i] : off[j]], off[i : j + 1] - off[i], model)
                yield pa.record_batch({"doc_id": batch["doc_id"][i:j].cast(pa.int64())} | {k: pa.array(v) for k, v in out.items()})

    return docs.select("doc_id", "text").mapInArrow(work, SCORES)


def filter_documents(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = texts_of(batch["text"])
            for i, j in runs(off):
                kept = verdicts(buf[off[i] : off[j]], off[i : j + 1] - off[i], model)["kept"]
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(work, docs.schema)

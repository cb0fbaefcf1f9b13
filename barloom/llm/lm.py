"""LM scoring by deleted interpolation of n-gram estimates.

A trigram, a bigram, a unigram and a uniform estimate are mixed; the mixture weights depend on how
often the context stands in the corpus (buckets by powers of two: of the pair of words before the
token if that stands in the training documents CUT times, else of the word before it alone, and
then without a trigram). Weights are learned by expectation maximisation on held-out counts: each
training token is scored by the counts that remain when that occurrence is deleted. The tokens'
estimates enter EM as counts over a grid of context bucket and octaves of the three
estimates, whose size does not grow with the corpus; each bucket is fitted on its own.

Counts go through buckets of n-grams (see chunks.py): every chunk of documents asks once for each
distinct n-gram in it, and adds its own training counts to the request; trigrams are asked for when
the counts of their first two words are known. The counts are exact (n-grams of several words by
40 bits of a fingerprint beside their bucket) and cover all training documents; the answers follow
the order of the requests.

Defined cases: null text counts as empty; every text ends with one end token, so an empty text has
one token; a document of null id is a training document; repeated rows are trained on and scored
once each; an n-gram that was never seen has estimate 0 and is carried by the lower ones; with no
training documents all weight lies on the uniform estimate; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import chunks
from barloom.llm.textkit import LOWER, SPACE, U64, heads, ids_back, ids_of, mix, pack, runs, texts_of, unpack, word_hash, words

END = mix(np.array([0x454E44], U64), 1)[0]
BUCKETS = 40
"""Context buckets: 0 for an unseen context, else one more than the whole part of log2 of its count; those of pairs follow those of single words."""
CUT = 2
"""Trigram estimates need a pair that stands so often; the deleted count of a rarer one is 0."""
STEPS = 1
"""Grid steps of an estimate in an octave; a cell holds the sums of its tokens' logarithms."""
ROUNDS = 60
WIDTH = {0: 8, 1: 5, 3: 5}
"""Bytes of a key of one, two and three words; kind 2 holds the weights."""
LEVELS = (3, 2, 1)
HELD_KEYS = 4_000_000
"""Distinct tokens that a task gathers before it sends them (32 MB)."""
GRID = "bucket int, step3 int, step2 int, step1 int, n double, log3 double, log2 double, log1 double"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, each document closed by END, and where documents begin."""
    buf = LOWER[buf]
    starts, ends, bounds = words(buf, off, SPACE)
    n = len(off) - 1
    first = bounds + np.arange(n + 1)
    out = np.full(first[-1], END, U64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(starts)) + doc] = word_hash(buf, starts, ends)
    return out, first


def pairs(token: np.ndarray) -> np.ndarray:
    """Fingerprints of each token with the one before it; the first of a document follows an END."""
    return mix(token ^ mix(np.r_[END, token[:-1]].astype(U64), 11), 12)


def triples(token: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Fingerprints of each token with the pair that ends before it."""
    return mix(token ^ mix(np.r_[END, pair[:-1]].astype(U64), 13), 14)


def vocabulary(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the training documents. Tasks send their distinct tokens, sorted and packed, to buckets."""

    def send(keys: list[np.ndarray], n: int) -> pa.RecordBatch:
        own = np.unique(np.concatenate(keys))
        rows = list(chunks.parcels(own, buckets, 0, 0, lambda s: s))
        return pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([n] + [0] * (len(rows) - 1)), "body": pa.array([pack(own[r[3]], 8) for r in rows], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held = [], 0, 0
        for batch in batches:
            buf, off = texts_of(batch["text"])
            for i, j in runs(off):
                token, _ = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                keys.append(np.unique(token))
                n, held = n + len(token), held + len(keys[-1])
            if held > HELD_KEYS:
                keys = [np.unique(np.concatenate(keys))]
                held = len(keys[0])
                if held > HELD_KEYS // 2:
                    yield send(keys, n)
                    keys, n, held = [], 0, 0
        if n:
            yield send(keys, n)

    def distinct(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unpack(b, 8) for b in table["body"].to_pylist()]))
        return pa.table({"n": pa.array([sum(table["n"].to_pylist())]), "types": pa.array([len(keys)])})

    sent = docs.where(~F.col("held_out")).select("text").mapInArrow(count, "bucket int, n long, body binary")
    told = sent.groupBy("bucket").applyInArrow(distinct, "n long, types long").agg(F.sum("n"), F.sum("types")).first()
    return int(told[0] or 0), int(told[1] or 0)


def learn(grid: pa.Table) -> pa.Table:
    """Weights of the trigram, bigram, unigram and uniform estimates for one context bucket, by expectation maximisation over its part of the grid."""
    n = grid["n"].to_numpy()
    estimates = [np.where(grid[f"step{k}"].to_numpy() < 0, 0, np.exp2(grid[f"log{k}"].to_numpy() / n)) for k in LEVELS]
    estimates = np.stack([*estimates, np.exp2(grid["log0"].to_numpy())])
    weights = np.full(4, 0.25)
    for _ in range(ROUNDS):
        share = weights[:, None] * estimates
        share *= n / share.sum(0)
        sums = share.sum(1) + 0.1 * (estimates.max(1) > 0)
        weights = sums / sums.sum()
    bucket = grid["bucket"][0].as_py()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "body": pa.array([np.r_[bucket, weights].astype("<f8").tobytes()], pa.binary())})


def table_of(body: bytes | None) -> np.ndarray:
    """Weights of all buckets. One that was not fitted has those of the next lower one of its kind; without one, a pair's those of a word, and an unseen word's half unigram, half uniform."""
    fitted = {int(r[0]): r[1:] for r in np.frombuffer(body or b"", "<f8").reshape(-1, 5)}
    weights = np.tile([0.0, 0.0, 0.5, 0.5] if fitted else [0.0, 0.0, 0.0, 1.0], (2 * BUCKETS, 1))
    for base in (0, BUCKETS):
        last = None
        for b in range(base, base + BUCKETS):
            last = fitted.get(b, last)
            weights[b] = last if last is not None else weights[b - base]
    return weights


class Counts:
    """A chunk's tokens with their counts."""

    def __init__(self, table: pa.Table, answers: pa.Table, trigrams: bool = True):
        buf, off = texts_of(table["text"])
        parts = [(i, *tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in runs(off)]
        self.token = np.concatenate([t for _, t, _ in parts])
        starts, at = [], 0
        for _, t, first in parts:
            starts.append(first[:-1] + at)
            at += len(t)
        self.first = np.concatenate(starts)
        self.size = np.diff(np.r_[self.first, len(self.token)])
        before = lambda x: np.r_[0, x[:-1]]
        self.count = self._look_up(self.token, answers, 0)
        self.context = before(self.count)
        # A document's first token follows an END, whose count is the number of documents, and no pair.
        self.context[self.first] = self.count[self.first + self.size - 1]
        key = np.concatenate([pairs(t) for _, t, _ in parts])
        self.pair = self._look_up(key, answers, 1)
        self.outer = before(self.pair)
        self.outer[self.first] = 0
        self.outer[self.outer < CUT] = 0
        self.asked = np.flatnonzero(self.outer)
        self.triple_key = triples(self.token, key)[self.asked]
        self.triple = np.zeros(len(self.token), np.int64)
        if trigrams:
            self.triple[self.asked] = self._look_up(self.triple_key, answers, 3)

    @staticmethod
    def _look_up(key: np.ndarray, answers: pa.Table, kind: int) -> np.ndarray:
        own, at = np.unique(key, return_inverse=True)
        got = chunks.bodies(answers, kind)
        totals = np.concatenate([unpack(b, 8) for _, _, b in got] or [np.zeros(0, U64)]).astype(np.int64)
        assert len(totals) == len(own)
        return totals[at]


def _requests(table: pa.Table, kind: int, key: np.ndarray, use: np.ndarray, n: int) -> Iterator[tuple]:
    """Distinct keys with the number of their occurrences that are used for training."""
    order = np.argsort(key)
    key = key[order]
    first = heads(key)
    count = np.add.reduceat(use[order].astype(U64), first) if len(first) else key
    key = key[first]
    return chunks.parcels(key, n, int(table["chunk"][0].as_py()), kind, lambda s: pack(key[s], WIDTH[kind]) + pack(count[s], 4))


def _trained(table: pa.Table) -> np.ndarray:
    return ~table["held_out"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)


def score_documents(docs: DataFrame, held_out=None) -> DataFrame:
    """Token counts, base score and score of every document. held_out: a Column that is true for documents that are not trained on."""
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    texts, n = chunks.deal(docs, ["held_out"])
    n_train, n_types = vocabulary(docs, n)
    log_uniform = -float(np.log2(n_types + 1))

    def ask(table: pa.Table) -> list[tuple]:
        buf, off = texts_of(table["text"])
        trained = _trained(table)
        unigrams, bigrams, use = [], [], []
        for i, j in runs(off):
            token, first = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            unigrams.append(token)
            bigrams.append(pairs(token))
            use.append(np.repeat(trained[i:j], np.diff(first)))
        use = np.concatenate(use)
        return [p for kind, key in ((0, unigrams), (1, bigrams)) for p in _requests(table, kind, np.concatenate(key), use, n)]

    def ask_triples(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return chunks.parcel_table([])
        model = Counts(table, answers, trigrams=False)
        use = np.repeat(_trained(table), model.size)[model.asked]
        return chunks.parcel_table(list(_requests(table, 3, model.triple_key, use, n)))

    def add_up(table: pa.Table) -> list[tuple]:
        out = []
        for kind, width in WIDTH.items():
            got = chunks.bodies(table, kind)
            if not got:
                continue
            sizes = [len(b) // (width + 4) for _, _, b in got]
            key = np.concatenate([unpack(b[: m * width], width) for (_, _, b), m in zip(got, sizes, strict=True)])
            count = np.concatenate([unpack(b[m * width :], 4) for (_, _, b), m in zip(got, sizes, strict=True)])
            order = np.argsort(key)
            first = heads(key[order])
            total = np.empty(len(key), U64)
            total[order] = np.repeat(np.add.reduceat(count[order], first), np.diff(np.r_[first, len(key)]))
            cuts = np.r_[0, np.cumsum(sizes)]
            out += [(b, c, kind, pack(total[i:j], 8)) for (b, c, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True)]
        return out

    def bucket_of(outer: np.ndarray, context: np.ndarray) -> np.ndarray:
        octave = lambda count: np.minimum(np.where(count > 0, np.frexp(np.maximum(count, 1).astype(float))[1], 0), BUCKETS - 1)
        return np.where(outer > 0, BUCKETS + octave(outer), octave(context))

    def held_out_counts(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({f.split()[0]: pa.array([], pa.int32() if f.endswith("int") else pa.float64()) for f in GRID.split(", ")})
        if not len(table):
            return empty
        model = Counts(table, answers)
        use = np.repeat(_trained(table), model.size)
        outer, context, triple, pair, count = (np.maximum(x[use] - 1, 0) for x in (model.outer, model.context, model.triple, model.pair, model.count))
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = {
                3: np.where(triple > 0, np.log2(np.maximum(triple, 1) / np.maximum(outer, 1)), 0.0), 2: np.where(pair > 0, np.log2(np.maximum(pair, 1) / np.maximum(context, 1)), 0.0),
                1: np.where(count > 0, np.log2(np.maximum(count, 1) / max(n_train - 1, 1)), 0.0),
            }
        cell = bucket_of(outer, context)
        for k, seen in zip(LEVELS, (triple > 0, pair > 0, count > 0), strict=True):
            cell = cell * 256 + np.where(seen, np.minimum(np.rint(-logs[k] * STEPS), 254), -1).astype(np.int64) + 1
        own, at = np.unique(cell, return_inverse=True)
        if not len(own):
            return empty
        steps = {f"step{k}": pa.array(((own >> 8 * (k - 1) & 255) - 1).astype(np.int32)) for k in LEVELS}
        return pa.table({"bucket": pa.array((own >> 24).astype(np.int32))} | steps | {"n": pa.array(np.bincount(at).astype(float))} | {f"log{k}": pa.array(np.bincount(at, logs[k])) for k in LEVELS})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        model = Counts(table, answers)
        learned = chunks.bodies(answers, 2)
        w = table_of(learned[0][2] if learned else None)[bucket_of(model.outer, model.context)]
        share = lambda count, context: count / np.maximum(context, 1)
        p = w[:, 0] * share(model.triple, model.outer) + w[:, 1] * share(model.pair, model.context) + w[:, 2] * share(model.count, n_train) + w[:, 3] * 2.0**log_uniform
        base = np.log10((model.count + 1) / (n_train + 1 * (n_types + 1)))
        ids = ids_of(table["doc_id"])
        return pa.table({
            "doc_id": ids_back(ids), "held_out": table["held_out"].combine_chunks(), "n_tokens": pa.array(model.size), "n_known": pa.array(np.add.reduceat((model.count > 0).astype(np.int64), model.first)),
            "train_tokens": pa.array(np.full(len(ids), n_train)), "base_score": pa.array(np.add.reduceat(base, model.first)), "score": pa.array(np.add.reduceat(np.log10(p), model.first)),
        })

    answers = chunks.answer(chunks.first_step(texts, ask), add_up).repartition("chunk")
    answers = answers.unionByName(chunks.answer(chunks.next_step(texts, answers, ask_triples), add_up).repartition("chunk"))
    grid = chunks.next_step(texts, answers, held_out_counts, GRID)
    steps, sums = [f"step{k}" for k in LEVELS], ["n", *(f"log{k}" for k in LEVELS)]
    grid = grid.groupBy("bucket", *steps).agg(*[F.sum(c).alias(c) for c in sums])
    fitted = grid.withColumn("log0", F.lit(log_uniform)).groupBy("bucket").applyInArrow(learn, "bucket int, body binary")
    # One row of at most 2 * BUCKETS weights.
    fitted = fitted.agg(F.array_sort(F.collect_list(F.struct("bucket", "body"))).alias("x")).select(F.unhex(F.concat_ws("", F.transform("x", lambda x: F.hex(x["body"])))).alias("body"))
    to_all = fitted.select(F.lit(0).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"), F.lit(2).alias("kind"), "body")
    return chunks.next_step(texts, answers.unionByName(to_all), lambda t, a: score(t, a) if len(t) else pa.table({f.name: pa.array([], f.type) for f in _EMPTY}), SCORES)


_EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

"""Benchmark decontamination with a distributed positional inverted index.

build_index() cuts the documents into shards (runs of documents of about 4 MB) and writes, as a
table, one row for each term of a shard with the sorted positions at which it stands, and one row
for each shard with its documents. Positions are stored as gaps of 7 bits a byte. The index holds all terms of all documents, whatever the
benchmark is, and can be asked again.

find() asks it by joins. Test items give windows of terms; the frequencies of their terms are
summed over the index, and a window that has a term without postings is dropped. A window meets
only the shards that hold its rarest term. There its lists are intersected from the rarest term
on, each shifted by its offset in the window, until all terms are used (exact phrases); or, for
proximity matches, there must be a start from which every term stands within `slop` words of its
place. Proximity is asked of full windows only, since the words of a shorter item may stand near each other by chance.
Neither documents, postings nor windows pass through the driver.

Defined cases: null or empty texts have no words and no hits; an item shorter than the window is
one window; items without words or with null text match nothing; items of null id are one item,
counted last; null document ids are passed through; repeated rows and repeated items give their
own results; other columns are ignored, and kept by clean_documents(); empty tables give no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.session import drop_folder, shared_folder
from barloom.llm.textkit import LOWER, NOT_TERM, cover, heads, runs, texts_of, word_hash, words

WINDOW = 10
SLOP = 1
"""Words by which a term may miss its place in a proximity match."""
SHARD_BYTES = 4 << 20
SMALL_ROWS = 1_000_000
"""Terms or documents, of 40 bytes at most, are broadcast if they have been counted to be no more than this."""

INDEX = "kind int, shard long, term long, n long, body binary"
"""kind 0: a shard's documents, n of them (body: id, whether it is null, two marks of the text, first word; then the number of words). kind 1: a term's n positions in the shard, as gaps()."""
HITS = "doc_id long, mark array<long>, shard long, row int, n_words long, n_hit long, spans array<struct<start:long,end:long>>, windows array<string>, near array<string>"


def gaps(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of rising numbers (one after another, each beginning at one of first) as bytes: differences in groups of 7 bits, the lowest first; and where each list begins and the last one ends."""
    d = np.diff(values, prepend=0)
    d[first] = values[first]
    size = np.ones(len(d), np.int64)
    for k in range(7, 63, 7):
        size += d >= 1 << k
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(size.max(initial=0)):
        own = np.flatnonzero(size > k)
        out[(ends - size)[own] + k] = d[own] >> 7 * k & 127 | (size[own] > k + 1) << 7
    return out, np.r_[(ends - size)[first], len(out)]


def ungap(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of the lists of gaps(); n: how many each list has, one at least."""
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    d = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)
    values = np.cumsum(d)
    head = np.cumsum(n) - n
    return values - np.repeat(values[head] - d[head], n)


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each item's windows as arrays of terms' fingerprints: item_id, terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = texts_of(batch["text"])
            for i, j in runs(off):
                part = LOWER[buf[off[i] : off[j]]]
                starts, ends, bounds = words(part, off[i : j + 1] - off[i], NOT_TERM)
                h = word_hash(part, starts, ends).view(np.int64)
                count = np.diff(bounds)
                size = np.minimum(count, window)
                n = np.where(count > 0, count - size + 1, 0)
                item = np.repeat(np.arange(j - i), n)
                first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + bounds[item]
                at = np.repeat(first, size[item]) + np.arange(size[item].sum()) - np.repeat(np.cumsum(size[item]) - size[item], size[item])
                cut = pa.array(np.r_[0, np.cumsum(size[item])].astype(np.int32))
                yield pa.record_batch({"item_id": batch["item_id"].take(pa.array(item + i)), "terms": pa.ListArray.from_arrays(cut, pa.array(h[at]))})

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(work, "item_id long, terms array<long>")


def build_index(docs: DataFrame, place: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the index of docs (doc_id, text) to place and read it again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, off = texts_of(batch["text"])
            for i, j in runs(off, shard_bytes):
                part = LOWER[buf[off[i] : off[j]]]
                starts, ends, bounds = words(part, off[i : j + 1] - off[i], NOT_TERM)
                h = word_hash(part, starts, ends)
                order = np.argsort(h, kind="stable")
                first = heads(h[order])
                cut = np.r_[first, len(order)]
                data, place = gaps(order, first)
                lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(place.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                ids = batch["doc_id"][i:j].cast(pa.int64())
                meta = np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), batch["m0"][i:j].to_numpy(), batch["m1"][i:j].to_numpy(), bounds[:-1]])
                yield pa.record_batch({
                    "kind": pa.array([0], pa.int32()), "shard": pa.array([shard]), "term": pa.array([0]), "n": pa.array([j - i]),
                    "body": pa.array([np.r_[meta.ravel(), bounds[-1]].astype("<i8").tobytes()], pa.binary()),
                })
                yield pa.record_batch({
                    "kind": pa.array(np.ones(len(first), np.int32)), "shard": pa.array(np.full(len(first), shard)), "term": pa.array(h[order[first]].view(np.int64)), "n": pa.array(np.diff(cut)),
                    "body": lists,
                })
                shard += 1

    marks = [F.xxhash64("text").alias("m0"), F.xxhash64(F.lit(1), "text").alias("m1")]
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *marks).mapInArrow(work, INDEX).write.partitionBy("kind").option("compression", "zstd").parquet(place)
    return docs.sparkSession.read.schema(INDEX).parquet(place)


class Shard:
    """A shard's documents, and the postings of some of its terms."""

    def __init__(self, table: pa.Table):
        kind = table["kind"].to_numpy()
        body = table["body"]
        meta = np.frombuffer(body[int(np.flatnonzero(kind == 0)[0])].as_py(), "<i8")
        rows, self.n_words = meta[:-1].reshape(5, -1), int(meta[-1])
        self.ids = pa.array(rows[0], mask=rows[1] > 0)
        self.marks = rows[2:4].T
        self.bounds = np.r_[rows[4], self.n_words]
        at = np.flatnonzero(kind == 1)
        n = table["n"].to_numpy()[at]
        places = ungap(np.frombuffer(b"".join(body.take(pa.array(at)).to_pylist()), np.uint8), n) if len(at) else np.zeros(0, np.int64)
        self.lists = dict(zip(table["term"].take(pa.array(at)).to_pylist(), np.split(places, np.cumsum(n)[:-1]), strict=True)) if len(at) else {}

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def phrase(self, plan: list[tuple[int, int]]) -> np.ndarray:
        """Starts of the exact occurrences inside one document. plan: (offset, term), the rarest first."""
        starts = self.lists[plan[0][1]] - plan[0][0]
        for off, term in plan[1:]:
            own = self.lists.get(term)
            if own is None or not len(starts):
                return np.zeros(0, np.int64)
            place = np.minimum(np.searchsorted(own, starts + off), len(own) - 1)
            starts = starts[own[place] == starts + off]
        starts = starts[(starts >= 0) & (starts + len(plan) <= self.n_words)]
        return starts[self.doc_of(starts) == self.doc_of(starts + len(plan) - 1)]

    def near(self, plan: list[tuple[int, int]], slop: int) -> np.ndarray:
        """Documents where from some start every term stands within slop words of its place."""
        lead = self.lists[plan[0][1]]
        starts = (lead[:, None] - plan[0][0] + np.arange(-slop, slop + 1)).ravel()
        doc = np.repeat(self.doc_of(lead), 2 * slop + 1)
        for off, term in plan[1:]:
            own = self.lists.get(term)
            if own is None or not len(starts):
                return np.zeros(0, np.int64)
            low = np.searchsorted(own, np.maximum(starts + off - slop, self.bounds[doc]))
            found = np.searchsorted(own, np.minimum(starts + off + slop + 1, self.bounds[doc + 1])) > low
            starts, doc = starts[found], doc[found]
        return np.unique(doc)


def find(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, windows): for every document of the index its hits, with the windows that occur in it and, if slop is given, those that are near; windows: window, item_id."""
    small = lambda df, n: F.broadcast(df) if n <= SMALL_ROWS else df.hint("shuffle_merge")
    place = f"{shared_folder(index.sparkSession)}/windows-{uuid.uuid4().hex}"
    windows_of(items, window).withColumn("window", F.md5(F.concat_ws(",", F.transform("terms", lambda t: t.cast("string"))))).write.parquet(place)
    told = index.sparkSession.read.parquet(place)
    placed = told.groupBy("window").agg(F.first("terms").alias("terms")).select("window", F.posexplode("terms").alias("off", "term"))
    terms = placed.select("term").distinct()
    n_terms = terms.count()
    postings = index.where("kind = 1").join(small(terms, n_terms), "term", "left_semi")
    postings.groupBy("term").agg(F.sum("n").alias("total")).write.parquet(f"{place}-totals")
    totals = index.sparkSession.read.parquet(f"{place}-totals")
    plans = placed.join(small(totals, n_terms), "term", "left").groupBy("window").agg(F.count("total").alias("known"), F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("total", "off", "term"))).alias("plan"))
    plans = plans.where("known = size").select("window", F.transform("plan", lambda x: F.struct(x["off"].alias("off"), x["term"].alias("term"))).alias("plan"), F.col("plan")[0]["term"].alias("term"))
    plans.write.parquet(f"{place}-plans")
    plans = index.sparkSession.read.parquet(f"{place}-plans")
    asked = index.where("kind = 1").select("term", "shard").join(small(plans, plans.count() * (window + 2)), "term").select(F.col("shard").alias("shard"), "window", "plan")

    def work(rows: pa.Table, windows: pa.Table) -> pa.Table:
        names = ("doc_id", "mark", "shard", "row", "n_words", "n_hit", "spans", "windows", "near")
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        shard = Shard(rows)
        n = len(shard.ids)
        found, sizes = [], []
        exact: list[list] = [[] for _ in range(n)]
        close: list[list] = [[] for _ in range(n)]
        for name, steps in zip(windows["window"].to_pylist(), windows["plan"].to_pylist(), strict=True):
            plan = [(s["off"], s["term"]) for s in steps]
            at = shard.phrase(plan)
            if len(at):
                found.append(at)
                sizes.append(np.full(len(at), len(plan)))
                for d in np.unique(shard.doc_of(at)).tolist():
                    exact[d].append(name)
            if slop is not None and len(plan) == window:
                for d in shard.near(plan, slop).tolist():
                    close[d].append(name)
        hit = cover(shard.n_words, np.concatenate(found), np.concatenate(sizes)) if found else np.zeros(shard.n_words, bool)
        sums = np.r_[0, np.cumsum(hit)]
        spans: list[list] = [[] for _ in range(n)]
        lit = np.flatnonzero(hit)
        doc = shard.doc_of(lit)
        head = heads(doc, lit - np.arange(len(lit)))
        for a, b in zip(lit[head], lit[np.r_[head[1:], len(lit)] - 1] if len(lit) else lit, strict=True):
            d = int(shard.doc_of(a))
            spans[d].append({"start": int(a - shard.bounds[d]), "end": int(b - shard.bounds[d]) + 1})
        cut = pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32))
        columns = (
            shard.ids, pa.ListArray.from_arrays(cut, pa.array(shard.marks.ravel())), pa.array(np.full(n, rows["shard"][0].as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(shard.bounds)),
            pa.array(sums[shard.bounds[1:]] - sums[shard.bounds[:-1]]), pa.array(spans, span), pa.array(exact, pa.list_(pa.string())), pa.array(close, pa.list_(pa.string())),
        )
        return pa.table(dict(zip(names, columns, strict=True)))

    listed = index.where("kind = 0").unionByName(postings.select(index.columns)).groupBy("shard")
    return listed.cogroup(asked.groupBy("shard")).applyInArrow(work, HITS), told.select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For every document: words, words inside any occurrence of a window, items, hit spans (in words, end excluded), items near."""
    place = f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    found, windows = find(build_index(docs, place, shard_bytes), items, window, slop)
    found.write.parquet(f"{place}-hits")
    drop_folder(docs.sparkSession, place)
    found = docs.sparkSession.read.parquet(f"{place}-hits")
    out = found
    for column, name in (("windows", "items"), ("near", "near_items")):
        some = found.select("shard", "row", F.explode(column).alias("window")).join(windows.hint("shuffle_merge"), "window")
        # Null ids are wrapped, since collect_set leaves nulls out; they are listed last.
        told = some.groupBy("shard", "row").agg(F.collect_set(F.struct(F.col("item_id").isNull().alias("none"), "item_id")).alias("x"))
        told = told.select("shard", "row", F.transform(F.array_sort("x"), lambda x: x["item_id"]).alias(name))
        out = out.join(told.hint("shuffle_merge"), ["shard", "row"], "left")
    none = F.array().cast("array<long>")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items"), "spans", F.coalesce("near_items", none).alias("near_items"))


def digest(hits: DataFrame) -> DataFrame:
    """The columns that the query returns; n_near: items with a window that stands exactly or within SLOP words."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """The documents without any benchmark window, exact or (unless slop is None) near, with all their columns. A document of null id is judged like any other.

    Contaminated rows are told by id and a 128-bit mark of their text.
    """
    place = f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    found, _ = find(build_index(docs.select("doc_id", "text"), place), items, window, slop)
    found.where("n_hit > 0 OR size(near) > 0").select(F.col("doc_id").alias("d"), F.col("mark")[0].alias("m0"), F.col("mark")[1].alias("m1")).distinct().write.parquet(f"{place}-hits")
    drop_folder(docs.sparkSession, place)
    gone = docs.sparkSession.read.parquet(f"{place}-hits")
    gone = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone.hint("shuffle_merge")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["d"]) & (F.xxhash64(docs["text"]) == gone["m0"]) & (F.xxhash64(F.lit(1), docs["text"]) == gone["m1"])
    return docs.join(gone, same, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])

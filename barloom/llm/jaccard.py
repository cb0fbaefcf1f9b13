"""N-gram Jaccard join with signature trees.

Documents with the same set of shingles are one class. Classes that can link at all are brought
together exactly, without pairs: if two sets of about s shingles reach the threshold, they differ
in at most D of them, so of D + M hashed parts of all shingles at least M hold the same shingles in
both (M is about D / 3). Every class asks which of its parts stand in another class. It is a
candidate only if those and its empty parts are M or more, so a passage shared by many unlike
documents makes none of them one. Candidates that share a part directly or through others form a
cluster, a superset of a component; parts with fewer shingles than a class's M-th smallest part
aren't needed for that. Where M parts are empty, the least shingles of a set (a prefix of its
order that two linked sets must share) are keys too.

Within a cluster, signature trees find the links: a node holds the OR of its members' shingle
bitmaps, their range of sizes and the largest number of shingles that a bitmap hides. Pairs of
nodes are traversed together from the root, and dropped when sizes exclude the threshold, when
the common bits (plus what bitmaps hide) are fewer than the overlap needed, or when all their
members are linked already. Pairs that reach the leaves are compared exactly.

A cluster is first compared with its hub, the class that shares parts with most others. A
cluster too large for a task is cut into tiles, each with a copy of the hub; the classes that
their tile does not link to the hub are gathered into tiles of their own, which meet all tiles.

A class is named by 128 bits of its set; shingles are 64-bit fingerprints.

Defined cases: null or empty texts have no shingles and are linked with nothing; texts with fewer
words than a shingle have their whole sequence as one shingle; a null id is larger than any other;
repeated rows are returned once each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import chunks
from barloom.llm.graph import components
from barloom.llm.session import shared_folder
from barloom.llm.textkit import LOWER, NO_ID, SPACE, U64, heads, ids_of, member, mix, pack, runs, span_hash, texts_of, unpack, window_starts, word_hash, words

SHINGLE = 3
PERCENT = 90
TASK_SHINGLES = 2_000_000
"""Shingles of a cluster, or of two tiles, that one task holds (16 MB)."""
BRIEF = 3
"""Bytes of a key by which buckets tell first whether another chunk may hold it; only then it is sent whole, with its owner."""
SMALL_ROWS = 1_000_000
"""Ids, of 40 bytes at most, are broadcast if they have been counted to be no more than this; the texts then stay where they are."""

SETS = "doc_id long, n int, name binary, keys array<long>, body binary"


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles in order, one document after another, and where each begins."""
    buf = LOWER[buf]
    starts, ends, bounds = words(buf, off, SPACE)
    h = word_hash(buf, starts, ends)
    n = np.diff(bounds)
    at = window_starts(bounds, size)
    short = np.flatnonzero((n > 0) & (n < size))
    begin = np.r_[at, bounds[short]]
    stop = np.r_[at + size, bounds[short + 1]]
    doc = np.repeat(np.arange(len(n)), n)[begin]
    key = span_hash(h, begin, stop, 5)
    order = np.argsort(key)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(n) < 65536 else np.int64), kind="stable")]
    key, doc = key[order], doc[order]
    first = heads(key, doc)
    return key[first], np.searchsorted(doc[first], np.arange(len(n) + 1))


def size_classes(most: int, percent: int = PERCENT) -> np.ndarray:
    """Least size of each class: linked sets lie in one class or in two that follow each other."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def part_keys(tokens: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of each set, under the scheme of its size class (slot 2 * set) and of the class below (slot 2 * set + 1).

    (key, slot, strong, need): strong keys suffice to bring linked sets together; need is how many
    keys of a slot another set must hold at least.
    """
    n = np.diff(first)
    edges = size_classes(int(n.max(initial=1)) + 1, percent)
    own = np.searchsorted(edges, n, "right") - 1
    edges = np.r_[edges, edges[-1] * 100 // percent + 1, (edges[-1] * 100 // percent + 1) * 100 // percent + 1]
    values = mix(tokens, 21)
    keys, slots, strong = [], [], []
    need = np.full(2 * len(n), np.iinfo(np.int64).max)
    for back in (0, 1):
        scheme = own - back
        use = np.flatnonzero((n > 0) & (scheme >= 0))
        top = edges[scheme[use] + 1] - 1
        differ = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
        use, differ = use[differ > 0], differ[differ > 0]
        if not len(use):
            continue
        agree = differ // 3 + 2
        parts = np.zeros(len(n), np.int64)
        parts[use] = differ + agree
        base = np.r_[0, np.cumsum(parts)]
        doc = np.repeat(np.arange(len(n)), n)
        pick = parts[doc] > 0
        t, doc = tokens[pick], doc[pick]
        part = ((t >> U64(32)) * parts[doc].astype(U64) >> U64(32)).astype(np.int64)
        place = base[doc] + part
        head = heads(place)
        load = np.bincount(place, minlength=base[-1])
        owner = np.repeat(np.arange(len(n)), parts)
        ranked = load[np.lexsort((load, owner))]
        enough = np.zeros(len(n), np.int64)
        enough[use] = ranked[base[use] + agree - 1]
        void = np.bincount(owner[load == 0], minlength=len(n))
        need[2 * use + back] = np.maximum(agree - void[use], 1)
        name = mix(scheme[doc[head]].astype(U64) << U64(32) | part[head].astype(U64), 22)
        keys.append(mix(np.add.reduceat(values[pick], head) ^ name, 23))
        slots.append(2 * doc[head] + back)
        strong.append(load[place[head]] >= enough[doc[head]])
        small = use[void[use] >= agree]
        size = np.zeros(len(n), np.int64)
        size[small] = n[small] + (-n[small] * percent) // 100 + 1
        inside = np.arange(len(tokens)) - np.repeat(first[:-1], n)
        lead = np.flatnonzero(inside < np.repeat(size, n))
        doc = np.repeat(np.arange(len(n)), n)[lead]
        keys.append(mix(mix(tokens[lead], 24) ^ scheme[doc].astype(U64), 25))
        slots.append(2 * doc + back)
        strong.append(np.ones(len(lead), bool))
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool), need
    return np.concatenate(keys), np.concatenate(slots), np.concatenate(strong), need


def _names(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint of each set, in two halves."""
    out = []
    for salt in (31, 35):
        total = np.r_[U64(0), np.cumsum(mix(tokens, salt))]
        out.append(mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(U64), salt + 1))
    return out[0], out[1]


def candidate_sets(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, number of shingles and the set's name; with strong keys and shingles if it is the chunk's first of a candidate class."""
    texts, n = chunks.deal(docs)
    low, brief = U64((1 << 48) - 1), U64((1 << 8 * BRIEF) - 1)

    def sets(table: pa.Table) -> Iterator[tuple]:
        buf, off = texts_of(table["text"])
        for i, j in runs(off):
            tokens, first = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
            yield tokens, first, _names(tokens, first)

    def probe(table: pa.Table) -> list[tuple]:
        keys = np.unique(np.concatenate([part_keys(tokens, first, percent)[0] for tokens, first, _ in sets(table)]))
        return list(chunks.parcels(keys, n, int(table["chunk"][0].as_py()), 0, lambda s: pack(np.unique(keys[s] & brief), BRIEF)))

    def elsewhere(table: pa.Table) -> list[tuple]:
        got = chunks.bodies(table)
        held = [unpack(b, BRIEF) for _, _, b in got]
        every = np.sort(np.concatenate(held))
        many = np.unique(every[1:][every[1:] == every[:-1]])
        return [(b, c, 0, pack(k, BRIEF)) for (b, c, _), own in zip(got, held, strict=True) if len(many) and len(k := own[member(many, own)[1]])]

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        told = np.sort(np.concatenate([U64(b << 8 * BRIEF) | unpack(body, BRIEF) for b, _, body in chunks.bodies(answers)] or [np.zeros(0, U64)]))
        keys, owners = [], []
        for tokens, first, name in sets(table):
            key, slot, _, _ = part_keys(tokens, first, percent)
            keys.append(key)
            # The owner's mark differs from key to key, so two classes can't agree in all their marks.
            owners.append(mix(name[0][slot >> 1] ^ key, 33) >> U64(32))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        one = heads(key, owner)
        key, owner = key[one], owner[one]
        # Held by two classes of this chunk, or perhaps by another chunk.
        same = key[1:] == key[:-1]
        ask = np.r_[same, False] | np.r_[False, same] if len(key) else np.zeros(0, bool)
        if len(told):
            ask |= member(told, chunks.bucket_of(key, n).astype(U64) << U64(8 * BRIEF) | key & brief)[1]
        key, owner = key[ask], owner[ask]
        return chunks.parcel_table(list(chunks.parcels(key, n, int(table["chunk"][0].as_py()), 0, lambda s: pack(key[s], 6) + pack(owner[s], 4))))

    def shared(table: pa.Table) -> list[tuple]:
        got = chunks.bodies(table)
        sizes = [len(b) // 10 for _, _, b in got]
        key = np.concatenate([unpack(b[: 6 * m], 6) for (_, _, b), m in zip(got, sizes, strict=True)])
        owner = np.concatenate([unpack(b[6 * m :], 4) for (_, _, b), m in zip(got, sizes, strict=True)])
        order = np.argsort(key)
        first = heads(key[order])
        owner = owner[order]
        many = np.empty(len(key), bool)
        many[order] = np.repeat(np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first), np.diff(np.r_[first, len(key)]))
        cuts = np.r_[0, np.cumsum(sizes)]
        return [(b, c, 0, pack(k, 6)) for (b, c, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True) if len(k := np.unique(key[i:j][many[i:j]]))]

    def gather(table: pa.Table, answers: pa.Table) -> pa.Table:
        got = chunks.bodies(answers)
        wanted = np.sort(np.concatenate([U64(b << 48) | unpack(body, 6) for b, _, body in got] or [np.zeros(0, U64)]))
        ids = ids_of(table["doc_id"])
        counts, names, keys, bodies, seen = [], [], [], [], set()
        for tokens, first, (high, rest) in sets(table):
            counts.append(np.diff(first))
            told = np.stack([high, rest], 1).astype("<u8").tobytes()
            own = [told[16 * k : 16 * k + 16] for k in range(len(high))]
            names += own
            if not len(wanted):
                keys += [None] * len(own)
                bodies += [None] * len(own)
                continue
            key, slot, strong, need = part_keys(tokens, first, percent)
            hit = member(wanted, chunks.bucket_of(key, n).astype(U64) << U64(48) | key & low)[1]
            able = np.bincount(slot[hit], minlength=len(need)) >= need
            hit &= strong & able[slot]
            key, doc = key[hit], slot[hit] >> 1
            order = np.argsort(doc, kind="stable")
            key, cut = key[order], np.searchsorted(doc[order], np.arange(len(first)))
            for k, name in enumerate(own):
                new = cut[k] < cut[k + 1] and name not in seen
                if new:
                    seen.add(name)
                keys.append(np.unique(key[cut[k] : cut[k + 1]]).view(np.int64) if new else None)
                bodies.append(tokens[first[k] : first[k + 1]].tobytes() if new else None)
        return pa.table({
            "doc_id": pa.array(ids), "n": pa.array(np.concatenate(counts or [np.zeros(0, np.int64)]).astype(np.int32)), "name": pa.array(names, pa.binary()),
            "keys": pa.array(keys, pa.list_(pa.int64())), "body": pa.array(bodies, pa.binary()),
        })

    asked = chunks.next_step(texts, chunks.answer(chunks.first_step(texts, probe), elsewhere), ask)
    return chunks.next_step(texts, chunks.answer(asked, shared), gather, SETS)


class Tree:
    """A signature tree over some sets; level 0 are the sets, in order of size."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        bits = 64
        while bits < 2 * self.size.max():
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), U64)
        for k, s in enumerate(sets):
            place = (s >> U64(20)) & U64(bits - 1)
            np.bitwise_or.at(maps[k], (place >> U64(6)).astype(np.int64), U64(1) << (place & U64(63)))
        hidden = self.size - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, self.size, self.size, hidden)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, hidden = self.levels[-1]
            cut = np.arange(0, len(maps), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


SLICE = 4096
"""Pairs of nodes that are looked at together."""


def local_components(sets: list[np.ndarray], hub: int, percent: int = PERCENT, group: np.ndarray | None = None) -> np.ndarray:
    """The component of each set among these, as the number of one of its members.

    group: sets of the same group are not compared with each other (they have been before).
    """
    m = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    group = None if group is None else group[order]
    parent = list(range(m))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    hub = int(np.flatnonzero(order == hub)[0])
    first = np.cumsum([0, *map(len, sets)])
    there = member(sets[hub], np.concatenate(sets))[1]
    common = np.add.reduceat(there.astype(np.int64), first[:-1])
    sizes = np.diff(first)
    for k in np.flatnonzero(100 * common >= percent * (sizes + len(sets[hub]) - common)).tolist():
        parent[k] = hub

    tree = Tree(sets)
    label = np.array([root(k) for k in range(m)])
    bounds: dict[int, tuple] = {}
    changed = False

    def ends(values: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        cut = np.arange(0, m, Tree.FAN**level)
        return np.minimum.reduceat(values, cut), np.maximum.reduceat(values, cut)

    groups = None if group is None else [ends(group, level) for level in range(len(tree.levels))]
    start = np.zeros(1, np.int64)
    waiting = [(len(tree.levels) - 1, start, start)]
    while waiting:
        level, i, j = waiting.pop()
        if len(i) > SLICE:
            waiting.append((level, i[SLICE:], j[SLICE:]))
            i, j = i[:SLICE], j[:SLICE]
        if changed:
            label, bounds, changed = np.array([root(k) for k in range(m)]), {}, False
        if level not in bounds:
            bounds[level] = ends(label, level)
        least, most = bounds[level]
        maps, low, high, hidden = tree.levels[level]
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        ok &= ~((least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j]))
        if groups is not None:
            g0, g1 = groups[level]
            ok &= ~((g0[i] == g1[i]) & (g0[j] == g1[j]) & (g0[i] == g0[j]))
        i, j = i[ok], j[ok]
        bits = np.bitwise_count(maps[i] & maps[j]).sum(1) + np.minimum(hidden[i], hidden[j])
        ok = (100 + percent) * bits >= percent * (low[i] + low[j])
        i, j = i[ok], j[ok]
        if level:
            step = np.arange(Tree.FAN)
            a = (i[:, None, None] * Tree.FAN + step[None, :, None]).repeat(Tree.FAN, 2).ravel()
            b = (j[:, None, None] * Tree.FAN + step[None, None, :]).repeat(Tree.FAN, 1).ravel()
            n = len(tree.levels[level - 1][0])
            ok = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
            if ok.any():
                waiting.append((level - 1, a[ok], b[ok]))
            continue
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if a != b and root(a) != root(b) and _linked(sets[a], sets[b], percent):
                parent[root(b)] = root(a)
                changed = True
    out = np.empty(m, np.int64)
    out[order] = order[[root(k) for k in range(m)]]
    return out


EDGES = "u binary, v binary, hub boolean"


def _link(percent: int, late: bool):
    """Links of one task's sets, as edges to one set of each component; hub: whether u is linked to the hub here."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = table["name"].to_pylist()
        side = table["side"].to_pylist() if late else [0] * len(names)
        own: dict[bytes, int] = {}
        for k in sorted(range(len(names)), key=lambda k: (names[k], side[k])):
            own.setdefault(names[k], k)
        names, order = list(own), list(own.values())
        sets = [np.frombuffer(table["body"][k].as_py(), "<u8") for k in order]
        hub = 0 if late else names.index(table["hub"][0].as_py())
        label = local_components(sets, hub, percent, np.array([side[k] for k in order]) if late else None)
        return pa.table({"u": pa.array(names, pa.binary()), "v": pa.array([names[k] for k in label], pa.binary()), "hub": pa.array(label == label[hub])})

    return work


def clustered(found: DataFrame, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Candidate classes (name, doc_id of a document that holds the set, n) with their cluster, its hub and their tile."""
    sets = found.where("body is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.flatten(F.collect_set("keys")).alias("keys"))
    pairs = sets.select("name", F.explode(F.array_distinct("keys")).alias("key"))
    lead = pairs.groupBy("key").agg(F.min("name").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = pairs.join(lead.hint("shuffle_merge"), "key").groupBy("name", "lead").agg(F.sum("size").alias("size")).checkpoint()
    roots = components(pairs.select(F.col("name").alias("u"), F.col("lead").alias("v")))
    degree = pairs.groupBy("name").agg(F.sum("size").alias("degree"))
    rows = sets.select("name", "doc_id", "n").join(degree.hint("shuffle_merge"), "name").join(roots.select(F.col("u").alias("name"), F.col("v").alias("root")).hint("shuffle_merge"), "name", "left")
    rows = rows.withColumn("cluster", F.coalesce("root", "name")).drop("root")
    facts = rows.groupBy("cluster").agg(F.max_by("name", F.struct("degree", "name")).alias("hub"), F.sum("n").alias("total"), F.max("n").alias("most"), F.count(F.lit(1)).alias("members"))
    rows = rows.join(facts.where("members > 1").hint("shuffle_merge"), "cluster")
    tiles = F.ceil((F.col("total") + F.col("most")) / (task_shingles / 4)).cast("int")
    tiles = F.when(F.col("total") <= task_shingles, 1).otherwise(tiles)
    return rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("name", F.lit(7)), F.col("tiles")).cast("int")).select("cluster", "name", "doc_id", "n", "hub", "tiles", "tile")


def links(found: DataFrame, placed: DataFrame, percent: int = PERCENT, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Edges (u, v) between classes that give the components of all links. placed: clustered(found)."""
    bodies = found.where("body is not null").select("name", "doc_id", "body")
    rows = placed.join(bodies.hint("shuffle_merge"), ["name", "doc_id"]).drop("doc_id")
    columns = ["cluster", "tile", "name", "body", "hub"]
    if placed.where("tiles > 1").limit(1).count() == 0:
        return rows.groupBy("cluster", "tile").applyInArrow(_link(percent, False), EDGES).select("u", "v")
    hubs = rows.where("name = hub and tiles > 1").select("cluster", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "name", "body", "hub")
    first = rows.select(*columns).unionByName(hubs).groupBy("cluster", "tile").applyInArrow(_link(percent, False), EDGES).checkpoint()
    # Classes that a tile did not link to the hub are dealt into few tiles of their own, which meet all tiles of their cluster.
    alone = first.groupBy("u").agg(F.max("hub").alias("hub")).where("not hub").select(F.col("u").alias("name"))
    alone = placed.where("tiles > 1").join(alone.hint("shuffle_merge"), "name", "left_semi")
    groups = alone.groupBy("cluster").agg(F.ceil((F.sum("n") + F.max("n")) / (task_shingles / 4)).cast("int").alias("groups"))
    alone = alone.join(groups.hint("shuffle_merge"), "cluster").withColumn("group", F.pmod(F.xxhash64("name", F.lit(8)), F.col("groups")).cast("int"))
    mine = alone.select("name", "group").hint("shuffle_merge")
    mine = rows.where("tiles > 1").join(mine, "name").select("cluster", "group", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "name", "body", F.lit(1).alias("side"))
    theirs = rows.where("tiles > 1").join(groups.hint("shuffle_merge"), "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "tile", "name", "body", F.lit(0).alias("side"))
    second = mine.unionByName(theirs).groupBy("cluster", "group", "tile").applyInArrow(_link(percent, True), EDGES)
    return first.select("u", "v").unionByName(second.select("u", "v"))


def join_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every document."""
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/jaccard-{uuid.uuid4().hex}"
    candidate_sets(docs, percent, size).write.parquet(place)
    found = spark.read.parquet(place)
    clustered(found, task_shingles).write.parquet(f"{place}-clusters")
    placed = spark.read.parquet(f"{place}-clusters")
    roots = components(links(found, placed, percent, task_shingles)).select(F.col("u").alias("name"), F.col("v").alias("root"))
    named = found.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least"))
    named = named.join(roots.hint("shuffle_merge"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least.hint("shuffle_merge"), "root").select("name", "component_id")
    out = found.select("doc_id", "n", "name").join(named.hint("shuffle_merge"), "name", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    null = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null(component).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs without those whose component has a smaller id; rows without shingles or without id stay, as do repeated rows of the id that is kept."""
    place = f"{shared_folder(docs.sparkSession)}/copies-{uuid.uuid4().hex}"
    join_documents(docs, percent, size).where("doc_id <> component_id").select("doc_id").distinct().write.parquet(place)
    gone = docs.sparkSession.read.parquet(place)
    gone = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone.hint("shuffle_merge")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

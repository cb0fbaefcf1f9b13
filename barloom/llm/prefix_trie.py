"""The trie of conversations' prefixes, by a van Emde Boas recursion over depth.

Sequences are cut at half depth; the cut prefixes get names, which are the roots of the lower
forests, and both halves are cut again, all pieces of a level in one job. Names of pieces of 2, 4, 8 ... turns come
from joining neighbours, so every prefix is named after as many levels as its depth has bits, each a
join on (conversation, place) in which no key has two rows; no task holds a conversation, a level or a
subtree. Equal prefixes have equal names (128 bits of SHA-256). Totals go the same way up:
a lower forest's roots hand theirs to the nodes above them in the upper trie, on their smallest
member's path, from pieces of one turn to the whole depth.

The order of turns comes from one range sort, whose counts by range give each turn its place, so a conversation may hold any share of the rows.
Members that end at a node are sorted by ranges as well and reach the node's digest in pieces of text.

Defined cases: null roles and texts are empty; turns of equal number are ordered by role, then text, and repeated rows
are turns of their own; rows of null conv_id are one conversation, larger than any other, which is not rebuilt and
shows as null, in the digest as an empty text (id 9223372036854775807 stands for it inside); ids below 0 round toward 0 in
c - c % 5; an empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.keyed import join_totals
from barloom.scratch import scratch_folder

NO_ID = 2**63 - 1
FAMILY, HEADS = 5, 9
RUN = 4096
"""Turns of a conversation that meet one row of its facts."""
PIECE = 1 << 16
"""Characters of members' ids in a piece."""


def named(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


ROOT = bytearray(hashlib.sha256(b"root").digest()[:16])


class Place:
    """Tables written below one folder."""

    def __init__(self, spark, name: str):
        self.spark, self.folder, self.n = spark, scratch_folder(spark, name), 0

    def put(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        rows.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.parquet(f"{self.folder}/{self.n}")


def turns(rows: DataFrame, place: Place) -> DataFrame:
    """c, pos (from 1), turn (its name) and n_bytes of the text, for each row of conversations."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    own = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("c"), F.col("turn").alias("k"), role.alias("role"), text.alias("text"))
    order = ["c", F.col("k").asc_nulls_first(), "role", "text"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    name = named(F.concat(F.octet_length("role").cast("string"), F.lit(":")).cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    # the range in the upper bits, the place in it in the lower 33
    dealt = place.put(dealt.select("c", F.monotonically_increasing_id().alias("at"), name.alias("turn"), F.octet_length("text").cast("long").alias("n_bytes")))
    part = F.shiftright("at", 33).alias("part")
    ranges = dealt.groupBy("c", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("c", "part", (before - F.col("first") + 1).alias("add"))
    met = dealt.withColumn("part", part).join(ranges.hint("shuffle_merge"), ["c", "part"])
    return place.put(met.select("c", (F.col("at") + F.col("add")).alias("pos"), "turn", "n_bytes"))


def rebuilt(told: DataFrame, place: Place) -> tuple[DataFrame, DataFrame]:
    """c, pos, turn, n_bytes, last of the rebuilt conversations; and c, size for each of them."""
    facts = told.groupBy("c").agg(F.max("pos").alias("n"))
    known = F.col("c") != NO_ID
    base = F.when(known, F.col("c") - F.col("c") % FAMILY)
    heads = F.when(known, F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).otherwise(F.lit(0).cast("long"))
    facts = place.put(facts.select("c", "n", base.alias("base"), heads.alias("h")))
    others = facts.select(F.col("c").alias("base"), F.col("n").alias("m")).hint("shuffle_merge")
    facts = facts.join(others, "base", "left").withColumn("m", F.least("h", F.coalesce("m", F.lit(0))))
    facts = place.put(facts.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    first = told.where(F.col("pos") < HEADS).withColumnRenamed("c", "base")  # at most 8 turns for each of 5 followers
    first = first.join(facts.select("c", "base", "h", "size").hint("shuffle_merge"), "base").where("pos <= h")
    each = facts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    rest = told.withColumn("run", F.expr(f"(pos - 1) div {RUN}")).join(each.select("c", "run", "h", "m", "size").hint("shuffle_merge"), ["c", "run"])
    rest = rest.where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    both = first.select("c", "pos", "turn", "n_bytes", "size").unionByName(rest.select("c", "pos", "turn", "n_bytes", "size"))
    return place.put(both.select("c", "pos", "turn", "n_bytes", (F.col("pos") == F.col("size")).alias("last"))), facts.select("c", "size")


def name_prefixes(rows: DataFrame, sizes: DataFrame, levels: int, place: Place) -> DataFrame:
    """c, depth, name for each prefix, the empty one included."""
    pieces = [rows.select("c", (F.col("pos") - 1).alias("k"), F.col("turn").alias("piece"))]
    for _ in range(levels - 1):
        pair = pieces[-1].groupBy("c", F.shiftright("k", 1).alias("k")).agg(F.min_by("piece", "k").alias("a"), F.max_by("piece", "k").alias("b"), F.count(F.lit(1)).alias("n"))
        pieces.append(place.put(pair.where("n = 2").select("c", "k", named(F.col("a"), F.col("b")).alias("piece"))))
    cut = sizes.select("c", F.lit(0).cast("long").alias("k"), F.lit(ROOT).alias("name"))
    for pieces_of_level in reversed(pieces):
        upper = pieces_of_level.where("k % 2 = 0").select("c", F.shiftright("k", 1).alias("k"), "piece")
        new = cut.join(upper.hint("shuffle_merge"), ["c", "k"]).select("c", (F.col("k") * 2 + 1).alias("k"), named(F.col("name"), F.col("piece")).alias("name"))
        cut = place.put(cut.select("c", (F.col("k") * 2).alias("k"), "name").unionByName(new))
    return cut.withColumnRenamed("k", "depth")


def graft(nodes: DataFrame, paths: DataFrame, values: list[str], levels: int, place: Place) -> DataFrame:
    """name and the values summed over the node's subtree. nodes: name, conv, depth, values; paths: c, depth, name."""
    totals = nodes.select("name", "conv", "depth", *values)
    steps = paths.select(F.col("c").alias("conv"), "depth", "name").hint("shuffle_merge")
    for j in range(levels):
        half = 1 << j
        roots = totals.where(F.col("depth") % (2 * half) == half)
        above = roots.select("conv", F.explode(F.sequence(F.col("depth") - half, F.col("depth") - 1)).alias("depth"), *values)
        given = above.join(steps, ["conv", "depth"]).select("name", F.lit(None).cast("long").alias("conv"), F.lit(None).cast("long").alias("depth"), *values)
        totals = totals.unionByName(given).groupBy("name").agg(F.max("conv").alias("conv"), F.max("depth").alias("depth"), *(F.sum(v).alias(v) for v in values))
        totals = place.put(totals)
    return totals.select("name", *values)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, c) as pieces (name, first c, ids with commas)."""
    name, first, held, size = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        return pa.record_batch([pa.array([name], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())], ["name", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column("name").to_pylist(), batch.column("c").to_pylist(), strict=True):
            if n != name or size > PIECE:
                if held:
                    yield piece()
                name, first, held, size = n, c, [], 0
            held.append("" if c == NO_ID else str(c))
            size += len(held[-1]) + 1
    if held:
        yield piece()


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as (name, SHA-256 of all of a name's)."""
    name, state = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])

    for batch in batches:
        for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n != name:
                if state:
                    yield done()
                name, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield done()


def digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of (name, c)."""
    pieces = ends.select("name", "c").repartitionByRange("name", "c").sortWithinPartitions("name", "c").mapInArrow(joined, "name binary, first long, ids string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digested, "name binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt (conv_id, turn, role, text)."""
    place = Place(conversations.sparkSession, "trie")
    rows, sizes = rebuilt(turns(conversations, place), place)
    deepest = sizes.agg(F.max("size")).first()[0] or 0
    levels = max(1, int(deepest).bit_length())
    paths = name_prefixes(rows, sizes, levels, place)
    told = rows.withColumnRenamed("pos", "depth").select("c", "depth", "n_bytes", "last")
    told = told.unionByName(sizes.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), (F.col("size") == 0).alias("last")))
    paths = place.put(paths.join(told.hint("shuffle_merge"), ["c", "depth"]))

    nodes = paths.groupBy("name").agg(F.min("c").alias("conv"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    over = paths.select(F.col("c").alias("conv"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = place.put(nodes.join(over.hint("shuffle_merge"), ["conv", "depth"], "left"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children.hint("shuffle_merge"), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = place.put(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}))

    totals = graft(nodes, paths, ["n_leaves", "saved_tokens"], levels, place)
    parents = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    own = nodes.drop("n_leaves", "saved_tokens", "n_bytes")
    met = join_totals(own.where("depth > 0").withColumnRenamed("n_children", "own_children"), parents, ["parent"], "n_children").withColumnRenamed("own_children", "n_children")
    met = met.unionByName(own.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    met = met.join(totals.hint("shuffle_merge"), "name").join(digests(paths.where("last")).hint("shuffle_merge"), "name", "left")
    no_one = F.lit(hashlib.sha256(b"").hexdigest())
    shown = [F.nullif(F.col(c), F.lit(NO_ID)).alias(a) for c, a in (("conv", "conv_id"), ("parent_conv_id", "parent_conv_id"))]
    return met.select(shown[0], "depth", shown[1], "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", no_one).alias("ends_sha256"))

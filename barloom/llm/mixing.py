"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a hashed order and cut into blocks of equal numbers of words.
Slots of the mix are golden-ratio points mapped through the sources' cumulative shares; slots
are ranked within their source, and the slot of rank r takes block r of the source, going round
a second time when the first pass ends. Where the points leave a source a slot or two short of
its target, the missing ranks follow at the end; a slot beyond it is dropped, and the last is cut to fit.
So each source gives its target to the word, and no document is taken more than twice.

All ranks are prefix sums in two levels, by hash range or slot range, so that a source with a
third of the rows is never in one task.

Defined cases: null text has size 0; a null source is a source of its own, sorted last; documents
of size 0 are returned with 0 words taken; repeated rows and ids are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
GOLDEN = (math.sqrt(5) - 1) / 2
CELLS = 4096
SMALL_SOURCES = 100_000
"""A table of sources is broadcast if it has been counted to have no more rows."""
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with target: words by weight, at most `most` times the source's size, the excess shared anew.

    The excess is shared until none is above; that is the level l at which the sum of
    min(most * size, l * weight) is the total, found from one prefix sum in the order of size / weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * share)
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return rows.withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule).

    documents: doc_id, source, size, source_size, target, taken, and where its words stand in the mix: first_slot and n_slots
    (blocks that hold some of them; null and 0 without). schedule: slot (order in the mix),
    source, block (number of the block in the source's repeated stream), start and end (words in that stream).
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumns({"key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "order": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})
    sized = sized.withColumn("range", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")).checkpoint()

    by_range = sized.groupBy("key", "source", "range").agg(F.sum("size").alias("words"))
    sources = targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    edge = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumns({
        "key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "goal": F.round("target").cast("long"),
        "low": F.coalesce(F.sum("target").over(edge.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "high": F.sum("target").over(edge.rowsBetween(Window.unboundedPreceding, 0)),
        "all": F.sum("target").over(Window.partitionBy(F.lit(0))),
    }).checkpoint()
    told = sources.agg(F.count(F.lit(1)), F.max("all")).first()
    small = F.broadcast if told[0] <= SMALL_SOURCES else lambda x: x.hint("shuffle_merge")
    n_slots = math.ceil((told[1] or 0) / block_words)

    offset = by_range.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("key", "range", "before")
    running = Window.partitionBy("key", "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(running), F.lit(0)))
    placed = placed.join(offset.hint("shuffle_merge"), ["key", "range"]).withColumn("at", F.col("before") + F.col("within"))
    placed = placed.join(small(sources.select("key", "source_size", "target", "goal")), "key").select("doc_id", "source", "key", "size", "source_size", "target", "goal", "at")

    cell = lambda c: F.least(F.greatest(F.floor(c / F.col("all") * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    spans = sources.where("target > 0").select("key", "low", "high", "goal", "all", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    point = F.expr(f"(id * {GOLDEN!r}D) % 1.0D")
    slots = docs.sparkSession.range(n_slots).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int")).withColumnRenamed("id", "slot")
    slots = slots.join(spans.hint("shuffle_hash"), "cell").where((F.col("u") * F.col("all") >= F.col("low")) & (F.col("u") * F.col("all") < F.col("high"))).select("slot", "key", F.expr("slot div 65536").alias("part"))
    parts = slots.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("key", "part").orderBy("slot")))
    ranked = ranked.join(parts.select("key", "part", "before").hint("shuffle_merge"), ["key", "part"]).select("slot", "key", (F.col("before") + F.col("r") - 1).alias("block"))
    given = parts.groupBy("key").agg(F.sum("n").alias("given"))
    needed = F.expr(f"(goal + {block_words - 1}) div {block_words}")
    late = sources.join(given.hint("shuffle_merge"), "key", "left").withColumn("given", F.coalesce("given", F.lit(0))).where(needed > F.col("given"))
    late = late.select(F.lit(n_slots).cast("long").alias("slot"), "key", F.explode(F.sequence(F.col("given"), needed - 1)).alias("block"))
    schedule = ranked.unionByName(late).join(small(sources.select("key", "source", "goal")), "key").where(F.col("block") * block_words < F.col("goal"))
    schedule = schedule.select("slot", "source", "key", "block", (F.col("block") * block_words).alias("start"), F.least((F.col("block") + 1) * block_words, F.col("goal")).alias("end"))

    passes = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("from", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    pieces = passes.where(F.col("from") < F.col("goal")).withColumn("block", F.explode(F.expr(f"sequence(from div {block_words}, (to - 1) div {block_words})")))
    joined = pieces.join(schedule.select("key", "block", "slot", "start", "end").hint("shuffle_merge"), ["key", "block"])
    words = joined.groupBy("doc_id", "key", "at", "size").agg(F.sum(F.least("to", "end") - F.greatest("from", "start")).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    words = words.withColumnsRenamed({"doc_id": "d", "key": "k", "at": "a", "size": "s"}).hint("shuffle_merge")
    same = placed["doc_id"].eqNullSafe(words["d"]) & (placed["key"] == words["k"]) & (placed["at"] == words["a"]) & (placed["size"] == words["s"])
    out = placed.join(words, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))
    return out, schedule.drop("key")

"""Line dedup with a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens (its pieces between spaces) lead it to a leaf: the number of tokens, then its
first LEAD tokens, where a token with a digit is a variable field. Within a leaf a token is
constant if it stands at its place in MIN_SHARE of the leaf's lines, and in MIN_DOCS documents or
more; all other places become variable, however frequent their values grow with the corpus. A line whose constant
words make up MIN_CONSTANT of its words (and are at least LEAST_CONSTANT) belongs to the template
that its constants form. A line with digits and fewer words than LEAST_CONSTANT stands for itself.
A template, or a line with the same words and fields, that stands in MIN_DOCS documents or more
recurs: its lines are dropped from all documents but the one of the smallest id, which keeps them,
so nothing is lost for good and the first of a group of copies stays whole.

Lines are first named by fingerprints (128 bits of the line, 64 of its leaf), and only these are
shuffled and written out, once for each document; the words of a line are fetched from the first document that holds it, for frequent
leaves alone. A line in a third of all documents is one partial sum in each task.

Defined cases: null text has no lines and stays null; blank lines stay; a null document id is
larger than any other; documents of equal id and text count once; other columns are kept by
drop_templates(); an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.session import shared_folder

LEAD = 3
MIN_DOCS = 5
MIN_SHARE = 0.1
MIN_CONSTANT = 0.7
LEAST_CONSTANT = 3
VARIABLE = "<*>"


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(line)


def _word(token: Column) -> Column:
    return (token != VARIABLE) & (token != "")


def _shape(line: Column) -> Column:
    """The masked line; the line itself if it has digits but fewer than LEAST_CONSTANT words."""
    masked = _masked(line)
    return F.when(line.rlike("[0-9]") & (F.size(F.filter(F.split(masked, " "), _word)) < LEAST_CONSTANT), line).otherwise(masked)


def _name(*values: Column) -> Column:
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def _filled(line: Column) -> Column:
    return F.trim(line) != ""


def _lines(text: Column) -> Column:
    """The shapes of the lines that are not blank."""
    return F.transform(F.filter(F.split(text, "\n", -1), _filled), _shape)


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, row, line): names of the lines to drop from the rows of docs (id, row, text)."""
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    leaf = lambda m: F.xxhash64(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))), F.substring_index(m, " ", LEAD))
    named = F.array_distinct(F.transform(_lines(F.col("text")), lambda m: F.struct(leaf(m).alias("leaf"), _name(m).alias("line"))))
    told = docs.select("id", "row", F.explode(named).alias("x")).select("id", "row", "x.leaf", "x.line").distinct()
    told.write.parquet(f"{place}/told")
    told = spark.read.parquet(f"{place}/told")

    lines = told.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row")).alias("first"))
    leaves = told.groupBy("leaf").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_docs)
    lines.join(leaves.hint("shuffle_merge"), "leaf").select("leaf", "total", "line", "n", "first.id", "first.row").write.parquet(f"{place}/lines")
    lines = spark.read.parquet(f"{place}/lines")

    wanted = lines.groupBy("id", "row").agg(F.collect_set("line").alias("lines")).withColumnsRenamed({"id": "i", "row": "r"}).hint("shuffle_merge")
    texts = docs.join(wanted, (docs["id"] == wanted["i"]) & (docs["row"] == wanted["r"])).select("lines", "text")
    texts = texts.select("lines", F.explode(F.array_distinct(_lines(F.col("text")))).alias("masked")).where(F.array_contains("lines", _name(F.col("masked"))))
    texts = texts.select(_name(F.col("masked")).alias("line"), "masked").dropDuplicates(["line"])
    known = lines.select("leaf", "total", "line", "n", F.col("id").alias("first")).join(texts.hint("shuffle_merge"), "line")
    known.write.parquet(f"{place}/known")
    known = spark.read.parquet(f"{place}/known").withColumn("size", F.size(F.filter(F.split("masked", " "), _word)))

    placed = known.select("leaf", "total", "line", "n", "first", "size", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    constant = placed.groupBy("leaf", "at", "token").agg(F.sum("n").alias("m"), F.max("total").alias("total"))
    constant = constant.where(F.col("m") >= F.greatest(F.lit(float(min_docs)), F.col("total") * MIN_SHARE)).select("leaf", "at", "token")
    shaped = placed.join(constant.hint("shuffle_merge"), ["leaf", "at", "token"]).groupBy("leaf", "line", "n", "first", "size").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("fixed"))
    constants = F.size(F.filter("fixed", lambda x: _word(x["token"])))
    shaped = shaped.where((constants >= MIN_CONSTANT * F.col("size")) & (constants >= LEAST_CONSTANT)).select("line", "n", "first", _name(F.col("leaf"), F.col("fixed")).alias("template"))
    # Written out, since it is read twice and its exchanges would lie beside those of the texts.
    shaped.write.parquet(f"{place}/shaped")
    shaped = spark.read.parquet(f"{place}/shaped")
    often = shaped.groupBy("template").agg(F.sum("n").alias("docs"), F.min("first").alias("keeper")).where(F.col("docs") >= min_docs).select("template", "keeper")
    dropped = shaped.join(often.hint("shuffle_merge"), "template").select("line", "keeper")
    equal = lines.where(F.col("n") >= min_docs).select("line", F.col("id").alias("keeper"))
    dropped = dropped.unionByName(equal).groupBy("line").agg(F.min("keeper").alias("keeper"))
    return told.select("id", "row", "line").join(dropped.hint("shuffle_merge"), "line").where(F.col("id") > F.col("keeper")).select("id", "row", "line")


def cut(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_lines (lines that are not blank), n_dropped and kept_text."""
    keyed = docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "row": F.xxhash64("text")})
    hits = recurring(keyed.select("id", "row", "text"), min_docs).groupBy("id", "row").agg(F.collect_set("line").alias("gone"))
    hits = hits.withColumnsRenamed({"id": "i", "row": "r"}).hint("shuffle_merge")
    out = keyed.join(hits, (keyed["id"] == hits["i"]) & (keyed["row"] == hits["r"]), "left").drop("i", "r", "id", "row")
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~_filled(x) | ~F.array_contains("gone", _name(_shape(x))))
    total = lambda text: F.coalesce(F.size(F.filter(F.split(text, "\n", -1), _filled)), F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    out = out.withColumns({"n_lines": F.when(F.col("text").isNull(), none).otherwise(total("text")), "kept_text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))})
    return out.withColumn("n_dropped", F.when(F.col("gone").isNull(), none).otherwise(F.col("n_lines") - total("kept_text"))).drop("gone")


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without recurring lines; documents that lose all their words go. n_chars, if there, follows the text."""
    names = docs.columns
    extra = [c for c in names if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in extra] or [F.lit(0).alias("none")]).alias("rest"))
    out = cut(packed, min_docs).where((F.col("n_dropped") == 0) | (F.col("n_lines") > F.col("n_dropped")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"), "n_chars": F.coalesce(F.length("kept_text").cast("long"), F.lit(0).cast("long")).alias("n_chars")}
    return out.select(*[own[c] if c in own and (c != "n_chars" or dict(docs.dtypes)[c] == "bigint") else F.col("rest")[c].alias(c) for c in names])


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return cut(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))

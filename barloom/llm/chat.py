"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor goes through the parts of a message in order. Text is escaped and copied; an image,
audio or document part becomes a placeholder `<image:t.p>` (turn and part number), while the
attachment's reference and its expanded token count are recorded. A turn is written as
`<turn:role>body</turn>`; texts and roles have `&`, `<` and `>` replaced by entities, so no text
can be taken for a control string and every text can be read back unchanged.

Defined cases: null text counts as empty; a null role as an empty one; a null turn comes first;
ties of turn go by role, then body, so repeated rows give repeated turns; rows without a
conversation id make one conversation; a part of unknown type counts as text; a message without
parts has an empty body; other columns are ignored. A conversation is one row of the result, so
one conversation has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
"""units: image tiles, seconds of audio or document pages; null: 1."""

TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
"""Fixed values: tokens that a placeholder expands to, for each unit of its attachment."""


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """The parts of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def _attached(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*TOKENS_PER_UNIT), F.lit(False))


def _tokens(part: Column) -> Column:
    per = F.create_map(*[F.lit(x) for pair in TOKENS_PER_UNIT.items() for x in pair])
    return (per[part["type"]] * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))).cast("long")


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, parts) as one row a conversation.

    formatted: the text. turns: for each turn its role, where its body begins, its length in code
    points, and whether it is under the loss mask (assistant). attachments: turn and part number,
    type, reference and expanded tokens, in order; attachment_tokens: their sum.
    """
    rows = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), escape(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts")
    )

    def visit(part: Column, k: Column) -> Column:
        mark = F.concat(F.lit("<"), part["type"], F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit("."), k.cast("string"), F.lit(">"))
        return F.when(_attached(part), mark).otherwise(F.coalesce(escape(part["text"]), F.lit("")))

    def record(part: Column, k: Column) -> Column:
        got = F.struct(F.col("turn"), k.cast("long").alias("part"), part["type"].alias("type"), part["ref"].alias("ref"), _tokens(part).alias("tokens"))
        return F.when(_attached(part), got)

    rows = rows.withColumns({
        "body": F.array_join(F.transform("parts", visit), ""),
        "attached": F.filter(F.transform("parts", record), lambda x: x.isNotNull()),
    }).withColumn("piece", F.concat(F.lit("<turn:"), "role", F.lit(">"), "body", F.lit("</turn>")))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(in_order), F.lit(0)))
    turn = F.struct(
        (F.col("at") + F.length("role") + 7).alias("start"), F.length("body").cast("long").alias("length"), unescape(F.col("role")).alias("role"), (F.col("role") == "assistant").alias("loss"), "piece", "attached"
    )
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), lambda a, b: (a["start"] - b["start"]).cast("int")).alias("t"))
    return rows.select(
        "conv_id",
        F.array_join("t.piece", "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))).alias("turns"),
        F.flatten("t.attached").alias("attachments"),
        F.aggregate(F.flatten("t.attached"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, body), unescaped."""
    pieces = F.filter(F.split(formatted, "</turn>", -1), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(7)), ">", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + 8)).alias("body")))


def digest(conversations: DataFrame) -> DataFrame:
    """The columns that the query returns, read back from the formatted text."""
    rows = conversations.withColumn("back", read_back(F.col("formatted")))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    masked = F.zip_with("back", "turns", lambda t, m: F.when(m["loss"], t["body"]))
    loss = F.array_join(masked, "")
    return rows.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""URL filter: rules by host and path, and for all other URLs a ratio of two character models.

The accepted model learns from URLs that an allow rule decides, the rejected one from those of block
rules. Each is a Markov model of variable order: a character is predicted from the longest contexts
(up to ORDER characters) that its class has seen, interpolated by Witten and Bell's weights down to
equal chances. A URL's score is the difference of the two log-likelihoods a character, end
included; it is accepted from a threshold on, calibrated on labelled URLs that neither model has seen.

A character's difference depends only on the last ORDER + 1 characters, so the models become one
table of such grams. Counts of grams are aggregated before the shuffle; all arithmetic after the logarithm is in
integers (millionths), so every engine gives the same verdicts. The table of grams is broadcast if it has been counted to
have at most SMALL_GRAMS rows; else grams meet it in a shuffle, spread over SALTS keys each.

Defined cases: a null URL and one without :// have neither host nor path, match no rule and are judged as an empty text;
characters outside of printable ASCII count as one symbol of the model; equal rows are judged once and returned as often
as they came; without labelled URLs of both kinds the threshold is 0 and an unseen class gives equal chances. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.scratch import scratch_folder

ALLOW, BLOCK = "allow", "block"
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
ORDER = 4
FOLDS = 5
"""One labelled URL in so many is kept for the calibration, by a hash of its host and path."""
UNIT = 1_000_000
BIN, MOST_BIN = 10_000, 2000
"""Thresholds are tried in steps of a hundredth, between -20 and 20 a character."""
SMALL_GRAMS = 250_000
SALTS = 32
START, END, OTHER = "\x02", "\x03", "~"
ODD = r"[^\x21-\x7D]"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null: none."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        named, verdict = F.when(fits, h + p).otherwise(named), F.when(fits, kind).otherwise(verdict)
    return named, verdict


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, the rule's verdict, and whether the row is one of the calibration."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    held = F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 7), 16, 10).cast("long") % FOLDS == 0
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), held.alias("held"))


def grams(host: Column, path: Column, order: int = ORDER) -> Column:
    """The order + 1 characters that end at each character, and at the end."""
    folded = F.regexp_replace(F.concat(host, path), ODD, OTHER)
    padded = F.concat(F.lit(START * order), folded, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))


def counted_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and how often accepted and rejected training URLs hold it, over the grams of all URLs."""
    good = ((F.col("ruled") == ALLOW) & ~F.col("held")).cast("long")
    bad = ((F.col("ruled") == BLOCK) & ~F.col("held")).cast("long")
    each = rows.select(F.coalesce(good, F.lit(0)).alias("good"), F.coalesce(bad, F.lit(0)).alias("bad"), F.explode(grams(F.col("host"), F.col("path"), order)).alias("gram"))
    return each.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and weight: the difference of its last character's log-probabilities, in millionths."""
    symbols = F.count(F.when(F.col("good") + F.col("bad") > 0, True)) + 1
    last = counts.groupBy(F.right("gram", F.lit(1)).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    base = last.agg((F.lit(1.0) / symbols).alias("p_good")).withColumn("p_bad", F.col("p_good"))
    found = None
    for k in range(order + 1):
        level = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = Window.partitionBy(F.left("gram", F.lit(k)))
        level = level.withColumns({f"{what}_{c}": f for c in ("good", "bad") for what, f in (("n", F.sum(c).over(context)), ("t", F.count(F.when(F.col(c) > 0, True)).over(context)))})
        if found is None:
            level = level.join(F.broadcast(base))  # one row
        else:
            level = level.withColumn("_rest", F.right("gram", F.lit(k))).join(found.hint("shuffle_merge"), "_rest")
        p = {c: F.when(F.col(f"n_{c}") == 0, F.col(f"p_{c}")).otherwise((F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))) for c in ("good", "bad")}
        found = level.select(F.col("gram").alias("_rest"), p["good"].alias("p_good"), p["bad"].alias("p_bad"))
    return found.select(F.col("_rest").alias("gram"), F.round((F.log("p_good") - F.log("p_bad")) * UNIT).cast("long").alias("weight"))


def scored(rows: DataFrame, weights: DataFrame, order: int = ORDER) -> DataFrame:
    """Distinct rows with copies, score (millionths, summed over n characters of all copies) and n."""
    each = rows.withColumn("gram", F.explode(grams(F.col("host"), F.col("path"), order)))
    if weights.limit(SMALL_GRAMS + 1).count() <= SMALL_GRAMS:
        met = each.join(F.broadcast(weights), "gram")
    else:
        salted = weights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("_salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
        met = each.join(salted.hint("shuffle_merge"), ["gram", "_salt"])
    ends = F.count(F.when(F.col("gram").endswith(END), True)).alias("copies")
    return met.groupBy(*rows.columns).agg(ends, F.sum("weight").alias("score"), F.count(F.lit(1)).alias("n"))


def step_of(score: Column, n: Column) -> Column:
    """The score a character in steps of BIN."""
    return F.least(F.greatest(F.floor(score.cast("double") / (n * BIN)).cast("long"), F.lit(-MOST_BIN)), F.lit(MOST_BIN))


def threshold(scores: DataFrame) -> int:
    """The step from which on a URL is accepted: the greatest sum of both classes' shares that are right; then the nearest to 0, then the lower one."""
    own = scores.where("held AND ruled IS NOT NULL").groupBy("step").agg(*(F.sum(F.when(F.col("ruled") == k, F.col("copies")).otherwise(0)).alias(k) for k in (ALLOW, BLOCK)))
    # one row a step at most, so 4,001 rows
    steps = own.select("step", ALLOW, BLOCK).unionByName(own.select((F.col("step") + 1).alias("step"), F.lit(0).cast("long").alias(ALLOW), F.lit(0).cast("long").alias(BLOCK)))
    steps = steps.groupBy("step").agg(F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    passed = {k: F.coalesce(F.sum(k).over(before), F.lit(0)) for k in (ALLOW, BLOCK)}
    all_of = {k: F.sum(k).over(whole) for k in (ALLOW, BLOCK)}
    right = (all_of[ALLOW] - passed[ALLOW]).cast("double") * all_of[BLOCK] + passed[BLOCK].cast("double") * all_of[ALLOW]
    best = steps.select("step", right.alias("right"), *(all_of[k].alias(f"all_{k}") for k in (ALLOW, BLOCK))).where(f"all_{ALLOW} > 0 AND all_{BLOCK} > 0")
    row = best.orderBy(F.desc("right"), F.abs("step"), "step").first()
    return row.step if row else 0


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule and verdict of (page_id, url), with score (millionths a character) and n_chars of the model."""
    spark, rows = pages.sparkSession, judged(pages, rules)
    place = scratch_folder(spark, "urls")
    counted_grams(rows, order).write.parquet(f"{place}/counts")
    model(spark.read.parquet(f"{place}/counts"), order).write.parquet(f"{place}/model")
    scores = scored(rows, spark.read.parquet(f"{place}/model"), order)
    scores.withColumn("step", step_of(F.col("score"), F.col("n"))).write.parquet(f"{place}/scores")
    scores = spark.read.parquet(f"{place}/scores")
    verdict = F.coalesce("ruled", F.when(F.col("step") >= threshold(scores), ALLOW).otherwise(BLOCK))
    out = scores.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.floor(F.col("score").cast("double") / F.col("n")).cast("long").alias("score"), F.expr("n div copies").alias("n_chars"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return out.drop("_copy")

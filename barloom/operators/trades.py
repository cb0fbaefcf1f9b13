"""From signals to trades: execution, exits, selection, sweeps, walk-forward and evaluation, all as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from barloom.functions.times import is_weekend
from barloom.operators.features import by_time
from barloom.operators.joins import meet
from barloom.operators.metrics import additive_equity
from barloom.scratch import scratch_folder

SPAN = 4096
"""Bars of a group that one task compares entries in."""

# Exits of one bar in order of priority.
EXITS = ("SL", "TRAIL", "TP", "TIME", "REGIME_OFF", "WEEKEND")


def next_bar_returns(signals: DataFrame, base: Column, stress: Column) -> DataFrame:
    """Entry at the next open, exit at the one after; net returns under two costs. Rows without positive prices go."""
    at = lambda c, k: F.lead(c, k).over(by_time())
    rows = signals.withColumns({"entry_price": at("open", 1), "exit_price": at("open", 2), "entry_time": at("time_utc", 1), "exit_time": at("time_utc", 2)}).where("entry_price > 0 and exit_price > 0")
    sign = F.when(F.col("side") == "SHORT", -1).otherwise(1)
    rows = rows.withColumn("gross_ret", sign * (F.col("exit_price") / F.col("entry_price") - 1))
    return rows.withColumns({"net_ret_base": F.col("gross_ret") - base, "net_ret_stress": F.col("gross_ret") - stress})


def clock_returns(signals: DataFrame, bars: DataFrame, horizons: Sequence[int], seconds: int) -> DataFrame:
    """Return to the close exactly h steps of the clock on, one row a signal and horizon; null where no bar stands there."""
    rows = signals.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("_at", F.col("time_utc") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("horizon") * seconds).cast("decimal(18,6)")))
    later = bars.select(F.col("symbol").alias("_s"), F.col("time_utc").alias("_t"), F.col("close").alias("later_close")).hint("shuffle_merge")
    out = rows.join(later, (F.col("symbol") == F.col("_s")) & (F.col("_at") == F.col("_t")), "left").drop("_s", "_t", "_at")
    return out.withColumn("fwd_ret", F.when(F.col("side") == "SHORT", -1).otherwise(1) * (F.try_divide("later_close", "close") - 1))


def number_bars(bars: DataFrame) -> DataFrame:
    """idx from 0 within each symbol, n bars of the symbol, the next open and whether this or the next bar is on a weekend."""
    return bars.withColumns({
        "idx": F.row_number().over(by_time()) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "next_open": F.lead("open").over(by_time()),
        "weekend": is_weekend(F.col("time_utc")), "next_weekend": F.coalesce(is_weekend(F.lead("time_utc").over(by_time())), F.lit(False)),
    })


def candidates(bars: DataFrame, weekdays_only: bool = True, check_execution: bool = True) -> DataFrame:
    """Bars (numbered, with conf_long, conf_short, atr) at which a position may open: long wins a tie, the last two bars don't count."""
    rows = bars.where((F.col("conf_long") | F.col("conf_short")) & (F.col("idx") < F.col("n") - 2) & (F.col("atr") > 0))
    if weekdays_only:
        rows = rows.where(~F.col("weekend"))
        rows = rows.where(~F.col("next_weekend")) if check_execution else rows
    side = F.when(F.col("conf_long"), "LONG").otherwise("SHORT")
    return rows.select("symbol", F.col("idx").alias("i"), F.col("time_utc").alias("signal_time"), side.alias("side"), F.coalesce("next_open", "close").alias("entry_price"), "atr")


def _quiet_exits(bars: DataFrame, time_stop: int, min_hold: int, gate_off_bars: int, weekdays_only: bool, block: int) -> DataFrame:
    """symbol, i and, for an entry at each bar, what doesn't depend on its prices: its first exit by time, regime or weekend on either
    side, and how far high and low go in the rest of its block."""
    ahead = lambda a, b: by_time().rowsBetween(a, max(a, b))
    wait = max(min_hold, gate_off_bars, 1)
    at = lambda rank: F.struct(F.col("idx").alias("j"), F.lit(rank).alias("rank"), F.col("close").alias("price"), F.col("time_utc").alias("exit_time"))
    rows = bars.withColumns({f"_on_{side}": F.max(F.when(F.col(f"gate_{side}"), F.col("idx"))).over(by_time().rowsBetween(Window.unboundedPreceding, 0)) for side in ("long", "short")})
    late = F.min(at(3)).over(by_time().rowsBetween(time_stop, time_stop))
    weekend = F.min(F.when(F.col("weekend") & F.lit(weekdays_only), at(5))).over(ahead(1, time_stop))

    def quiet(side: str) -> Column:
        off = F.coalesce(F.col("idx") - F.col(f"_on_{side}"), F.lit(gate_off_bars)) >= gate_off_bars
        regime = F.min(F.when(off, at(4))).over(ahead(wait, time_stop))
        return F.least(late, weekend, F.when(regime["j"] <= F.col("idx") + time_stop, regime))

    own = Window.partitionBy("symbol", F.expr(f"idx div {block}")).orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    return rows.select("symbol", F.col("idx").alias("i"), quiet("long").alias("_quiet_long"), quiet("short").alias("_quiet_short"), F.max("high").over(own).alias("_rest_high"), F.min("low").over(own).alias("_rest_low"))


def _block_index(bars: DataFrame, block: int, span: int) -> tuple[DataFrame, DataFrame]:
    """(symbol, block, its bars), and (symbol, span, the extremes of its blocks and the next span's): highest high, lowest low, and the
    greatest fall from a high so far and rise from a low so far inside the block."""
    one = F.struct(F.col("idx").alias("j"), "high", "low", F.col("time_utc").alias("exit_time"))
    held = bars.groupBy("symbol", F.expr(f"idx div {block}").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("path"))

    def swing(first: str, other: str, pick, sign: int) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("far"), F.lit(None).cast("double").alias("most"))

        def step(acc: Column, x: Column) -> Column:
            far = pick(acc["far"], x[first])
            return F.struct(far.alias("far"), F.greatest(acc["most"], sign * (far - x[other])).alias("most"))

        return F.aggregate("path", start, step, lambda acc: acc["most"])

    facts = F.struct("block", F.array_max(F.transform("path", lambda x: x["high"])).alias("high"), F.array_min(F.transform("path", lambda x: x["low"])).alias("low"), swing("high", "low", F.greatest, 1).alias("fall"), swing("low", "high", F.least, -1).alias("rise"))
    spans = held.select("symbol", facts.alias("f"), F.explode(F.array(F.expr(f"block div {span}"), F.expr(f"block div {span}") - 1)).alias("span"))
    return held, spans.groupBy("symbol", "span").agg(F.array_sort(F.collect_list("f")).alias("blocks"))


def label_exits(entries: DataFrame, bars: DataFrame, time_stop: int, min_hold: int, gate_off_bars: int, weekdays_only: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """The first bar at which an entry is closed, and why.

    entries: symbol, i, side, entry_price, atr, sl, tp, trail (multiples of atr; trail null or 0: none)
    and `keys`, one row for each of these. The trail follows the best price so far, the bar's own included. Entries still open at
    the last bar give no row.

    Time, regime and weekend are looked up once a bar. For prices an entry meets one row of extremes of blocks, where it
    finds the first block that its stop, goal or trail is in, and then the bars of that block and of the rest of its own: so
    the rows that are joined grow with entries, whatever time_stop is. Of a fall so near to the trail that rounding
    decides, the block is looked into and the search goes on.
    """
    block = max(2, round(time_stop**0.5))
    span = -(-time_stop // block) + 1
    held, spans = _block_index(bars, block, span)
    own = ["symbol", *keys, "i", "side"]
    long = F.col("side") == "LONG"
    sign = F.when(long, 1).otherwise(-1)
    rows = meet(entries, _quiet_exits(bars, time_stop, min_hold, gate_off_bars, weekdays_only, block), ["symbol", "i"])
    rows = rows.withColumns({
        "_quiet": F.when(long, F.col("_quiet_long")).otherwise(F.col("_quiet_short")), "_rest": F.when(long, F.greatest("entry_price", "_rest_high")).otherwise(F.least("entry_price", "_rest_low")),
        "_stop": F.col("entry_price") - sign * F.col("sl") * F.col("atr"), "_goal": F.col("entry_price") + sign * F.col("tp") * F.col("atr"), "_back": F.when(F.col("trail") > 0, F.col("trail") * F.col("atr")),
        "_trail": F.when(F.col("trail") > 0, sign * F.col("trail") * F.col("atr")), "block": F.expr(f"i div {block}"), "_last": F.expr(f"(i + {time_stop}) div {block}"),
    })
    yes = lambda x: F.coalesce(x, F.lit(False))
    below = lambda x, level: yes(F.when(long, x["low"] <= level).otherwise(x["high"] >= level))
    above = lambda x, level: yes(F.when(long, x["high"] >= level).otherwise(x["low"] <= level))
    beyond = lambda best, x: F.when(long, F.greatest(best, x["high"])).otherwise(F.least(best, x["low"]))

    def search(acc: Column, x: Column) -> Column:
        swing = F.when(long, x["fall"]).otherwise(x["rise"])
        sure = below(x, F.col("_stop")) | above(x, F.col("_goal")) | below(x, acc["best"] - F.col("_trail")) | yes(swing >= F.col("_back") * (1 + 1e-9))
        near = sure | yes(swing >= F.col("_back") * (1 - 1e-9))
        look = ~acc["done"] & (x["block"] > F.col("block")) & (x["block"] <= F.col("_last"))
        found = F.when(look & near, F.array_append(acc["found"], F.struct(x["block"].alias("block"), acc["best"].alias("best")))).otherwise(acc["found"])
        return F.struct(F.when(look, beyond(acc["best"], x)).otherwise(acc["best"]).alias("best"), (acc["done"] | (look & sure)).alias("done"), found.alias("found"))

    mine = F.array(F.struct(F.col("block"), F.col("entry_price").alias("best")))
    start = F.struct(F.col("_rest").alias("best"), F.lit(False).alias("done"), mine.alias("found"))
    rows = meet(rows.withColumn("span", F.expr(f"block div {span}")), spans, ["symbol", "span"])
    rows = rows.withColumn("_found", F.explode(F.aggregate("blocks", start, search, lambda acc: acc["found"]))).drop("blocks").withColumns({"block": F.col("_found.block"), "_best": F.col("_found.best")})

    event = "struct<j:int,rank:int,price:double,exit_time:timestamp>"

    def walk(acc: Column, x: Column) -> Column:
        best = beyond(acc["best"], x)
        trail = best - F.col("_trail")
        what = lambda rank, price: F.struct(x["j"].cast("int").alias("j"), F.lit(rank).alias("rank"), price.cast("double").alias("price"), x["exit_time"].alias("exit_time")).cast(event)
        here = F.when(below(x, F.col("_stop")), what(0, F.col("_stop"))).when(below(x, trail), what(1, trail)).when(above(x, F.col("_goal")), what(2, F.col("_goal")))
        inside = acc["event"].isNull() & (x["j"] > F.col("i")) & (x["j"] <= F.col("i") + time_stop)
        return F.struct(F.when(inside, best).otherwise(acc["best"]).alias("best"), F.when(inside, here).otherwise(acc["event"]).alias("event"))

    begin = F.struct(F.col("_best").cast("double").alias("best"), F.lit(None).cast(event).alias("event"))
    rows = meet(rows, held, ["symbol", "block"]).withColumn("_event", F.aggregate("path", begin, walk, lambda acc: acc["event"])).drop("path")
    first = rows.groupBy(*own, "entry_price", "signal_time").agg(F.least(F.min(F.col("_quiet").cast(event)), F.min("_event")).alias("x")).where("x IS NOT NULL")
    reasons = F.array(*[F.lit(r) for r in EXITS])
    out = first.select(*own, "signal_time", "entry_price", F.col("x.price").alias("exit_price"), F.col("x.j").alias("exit_idx"), F.col("x.exit_time").alias("exit_time"), F.element_at(reasons, F.col("x.rank") + 1).alias("exit_reason"))
    gross = F.when(F.col("side") == "LONG", 1).otherwise(-1) * (F.col("exit_price") / F.col("entry_price") - 1)
    return out.withColumns({"hold_bars": F.col("exit_idx") - F.col("i"), "gross_pnl": gross})


def next_entries(asked: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """asked (keys, at, ...) with next_i: the first entry (keys, i) at or after that number; null: none.

    Numbers are compared within blocks of SPAN; a question that its block can't answer takes the first
    entry of the next block that has one. So no task holds more of a group than a block, or one row for each of its blocks.
    """
    block = lambda c: F.expr(f"cast({c} as long) div {SPAN}").alias("_block")
    mine = asked.select("*", block("at"))
    extra = [c for c in asked.columns if c not in (*keys, "at")]
    kinds = dict(asked.dtypes)
    rows = mine.select(*keys, "_block", F.col("at").cast("long").alias("at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_entry"), *extra).unionByName(
        entries.select(*keys, block("i"), F.col("i").cast("long").alias("at"), F.lit(1).alias("_kind"), F.col("i").cast("long").alias("_entry"), *(F.lit(None).cast(kinds[c]).alias(c) for c in extra))
    )
    later = Window.partitionBy(*keys, "_block").orderBy("at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    here = rows.withColumn("_here", F.first("_entry", ignorenulls=True).over(later)).where("_kind = 0").drop("_kind", "_entry")
    blocks = rows.groupBy(*keys, "_block").agg(F.min("_entry").alias("_first"))
    after = F.first("_first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing))
    out = meet(here, blocks.select(*keys, "_block", after.alias("_after")), [*keys, "_block"])
    return out.withColumn("next_i", F.coalesce("_here", "_after")).drop("_block", "_here", "_after")


def chosen(entries: DataFrame, cooldown: int, keys: Sequence[str]) -> DataFrame:
    """keys and i of the entries that a single position takes, from written (keys, i, exit_idx) with one row for each i.

    Each entry points at the first one after its exit and the cooldown. A group's first entry is taken; then, round by round,
    what taken entries point at is taken as well, and all pointers double their reach: a chain of n trades needs log n rounds.
    """
    spark, place, rounds = entries.sparkSession, scratch_folder(entries.sparkSession, "chain"), 0

    def put(rows: DataFrame) -> tuple[DataFrame, int]:
        """The rows, written, and how many taken ones point on."""
        seen = Observation()
        rows.observe(seen, F.count_if(F.col("taken") & F.col("to").isNotNull()).alias("open")).write.parquet(f"{place}/{rounds}")
        return spark.read.schema(rows.schema).parquet(f"{place}/{rounds}"), seen.get["open"]

    first = entries.groupBy(*keys).agg(F.min("i").alias("_head"))
    asked = entries.select(*keys, F.col("i").cast("long").alias("i"), (F.col("exit_idx") + cooldown + 1).cast("long").alias("at"))
    nodes = meet(next_entries(asked, entries, keys), first, keys)
    nodes, ahead = put(nodes.select(*keys, "i", F.col("next_i").alias("to"), (F.col("i") == F.col("_head")).alias("taken")))
    while ahead:
        rounds += 1
        pushed = nodes.where("taken AND to IS NOT NULL").select(*keys, F.col("to").alias("i"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("taken"))
        nodes = nodes.unionByName(pushed).groupBy(*keys, "i").agg(F.max("to").alias("to"), F.max("taken").alias("taken"))
        live, done = nodes.where("to IS NOT NULL"), nodes.where("to IS NULL AND taken")
        onward = live.select(*keys, F.col("i").alias("to"), F.col("to").alias("_onward"))
        nodes, ahead = put(meet(live, onward, [*keys, "to"], "left").select(*keys, "i", F.col("_onward").alias("to"), "taken").unionByName(done))
    return nodes.where("taken").select(*keys, "i")


def without_overlap(labelled: DataFrame, cooldown: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Of entries with their exits, those that a single position takes: each begins after the exit before it and the cooldown.

    Of several entries at one bar the one that ends first counts. labelled is written once, only keys and numbers go round.
    """
    one = F.row_number().over(Window.partitionBy(*keys, "i").orderBy("exit_idx", *(c for c in labelled.columns if c not in (*keys, "i", "exit_idx"))))
    place = scratch_folder(labelled.sparkSession, "labelled")
    labelled.withColumn("_one", one).where("_one = 1").drop("_one").write.parquet(place)
    rows = labelled.sparkSession.read.parquet(place)
    return meet(rows, chosen(rows.select(*keys, "i", "exit_idx"), cooldown, keys), [*keys, "i"], "left_semi").select(*labelled.columns)


def next_match(exits: DataFrame, entries: DataFrame, cooldown: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """For each exit (exit_idx) the first entry at or after exit + cooldown + 1."""
    asked = exits.select(*keys, (F.col("exit_idx") + cooldown + 1).alias("at"), "exit_idx")
    return next_entries(asked, entries.select(*keys, "i"), keys).select(*keys, "exit_idx", F.col("next_i").cast(dict(entries.dtypes)["i"]).alias("next_i"))


def parameter_grid(spark, sl: Sequence[float], tp: Sequence[float], trail: Sequence[float], most: int | None = None) -> DataFrame:
    """Combinations in order of enumeration, those whose trail does not exceed the stop left out (trail 0: none); at most so many."""
    lists = [F.array(*[F.lit(float(x)) for x in v]) for v in (sl, tp, trail)]
    rows = spark.range(1).select(F.posexplode(lists[0]).alias("a", "sl"), F.lit(0).alias("_"))
    rows = rows.select("a", "sl", F.posexplode(lists[1]).alias("b", "tp")).select("a", "sl", "b", "tp", F.posexplode(lists[2]).alias("c", "trail")).where("trail = 0 or trail > sl")
    rows = rows.withColumn("combo", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("a", "b", "c")) - 1).select("combo", "sl", "tp", "trail")
    return rows if most is None else rows.where(F.col("combo") < most)


def sweep(entries: DataFrame, bars: DataFrame, folds: DataFrame, grid: DataFrame, time_stop: int, min_hold: int, gate_off_bars: int, cooldown: int) -> DataFrame:
    """Trades of every symbol, fold, part and combination in one job: exits once a combination, then one chain for each fold part."""
    from barloom.operators.folds import tag_segments

    rows = entries.join(F.broadcast(grid))
    labelled = label_exits(rows, bars, time_stop, min_hold, gate_off_bars, keys=("combo", "sl", "tp", "trail"))
    ends = folds.select("symbol", "fold_id", F.explode(F.array(F.struct(F.lit("IS").alias("segment"), F.col("is_end").alias("end")), F.struct(F.lit("OOS").alias("segment"), F.col("oos_end").alias("end")))).alias("p")).select("symbol", "fold_id", "p.segment", "p.end")
    tagged = tag_segments(labelled, folds, "signal_time").join(ends.hint("shuffle_merge"), ["symbol", "fold_id", "segment"]).where("exit_time <= end").drop("end")
    return without_overlap(tagged, cooldown, ("symbol", "fold_id", "segment", "combo"))


def tuning(trades: DataFrame, cost: float, least: int = 1, epsilon: float = 1e-12) -> DataFrame:
    """In-sample score of every symbol, fold and combination: sum over deviation."""
    rows = trades.where("segment = 'IS'").withColumn("net", F.col("gross_pnl") - cost)
    out = rows.groupBy("symbol", "fold_id", "combo").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("net").alias("sum_ret"), F.coalesce(F.stddev_samp("net"), F.lit(0.0)).alias("std_ret"), F.avg("net").alias("mean_ret"))
    return out.where(F.col("n_trades") >= least).withColumn("score", F.col("sum_ret") / F.greatest(F.lit(epsilon), F.col("std_ret")))


def best_of(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def walk_forward(trades: DataFrame, scores: DataFrame) -> DataFrame:
    """Out-of-sample trades of each fold's best combination; nothing is run again."""
    best = best_of(scores, ["symbol", "fold_id"], F.round("score", 9).desc(), F.col("combo")).select("symbol", "fold_id", "combo")
    return trades.where("segment = 'OOS'").join(best.hint("shuffle_merge"), ["symbol", "fold_id", "combo"], "left_semi")


def modal_parameters(best: DataFrame) -> DataFrame:
    """Each symbol's most frequent best combination; a tie goes to the one met in the earlier fold."""
    counts = best.groupBy("symbol", "combo").agg(F.count(F.lit(1)).alias("n"), F.min("fold_id").alias("first"))
    return best_of(counts, ["symbol"], F.col("n").desc(), F.col("first")).select("symbol", "combo", "n")


def selection(trades: DataFrame, order: Sequence[str], least: int, min_total: float, max_drawdown: float, min_win_rate: float, weights: tuple[float, float, float, float] = (0.15, 0.05, 1.25, 0.125)) -> DataFrame:
    """GO or NO_GO for each symbol and side, with score = total + a sharpe + b (win rate - .5) - c |drawdown| - d."""
    rows = additive_equity(trades, ["symbol", "side"], order, "net_pnl_base")
    out = rows.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("n_oos"), F.sum("net_pnl_base").alias("tot_ret"), F.avg((F.col("net_pnl_base") > 0).cast("double")).alias("win_rate"), F.min("drawdown").alias("mdd"),
        (F.avg("net_pnl_base") / F.greatest(F.lit(1e-12), F.stddev_samp("net_pnl_base"))).alias("sharpe"),
    )
    a, b, c, d = weights
    out = out.withColumn("score", F.when(F.col("n_oos") < least, 0.0).otherwise(F.col("tot_ret") + a * F.col("sharpe") + b * (F.col("win_rate") - 0.5) - c * -F.col("mdd") - d))
    go = (F.col("n_oos") >= least) & (F.col("tot_ret") >= min_total) & (F.col("mdd") >= max_drawdown) & (F.col("win_rate") >= min_win_rate)
    return out.withColumn("decision", F.when(go, "GO").otherwise("NO_GO"))


def go_or_best(selected: DataFrame, k: int = 2) -> DataFrame:
    """Rows that are GO; if there are none, the k best by score."""
    rows = selected.withColumns({"_go": F.count_if(F.col("decision") == "GO").over(Window.partitionBy(F.lit(0))), "_rn": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("score", 9).desc(), "symbol", "side"))})
    return rows.where(F.when(F.col("_go") > 0, F.col("decision") == "GO").otherwise(F.col("_rn") <= k)).drop("_go", "_rn")


def trade_qa(trades: DataFrame, signals: int | None = None) -> DataFrame:
    """One row of counts that should be zero."""
    return trades.agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("entry_time") <= F.col("signal_time")).alias("lookahead"), F.count_if(is_weekend(F.col("entry_time"))).alias("weekend_entries"),
        F.count_if(F.col("net_pnl_stress") > F.col("net_pnl_base")).alias("stress_above_base"), F.count_if(F.col("exit_time") <= F.col("entry_time")).alias("exit_before_entry"),
    ).withColumn("more_than_signals", F.greatest(F.col("n_trades") - (signals if signals is not None else F.col("n_trades")), F.lit(0)))


def stability(folds: DataFrame) -> DataFrame:
    """Score and status of each symbol and side from its folds (fold_return, fold_pf, fold_wr)."""
    out = folds.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg((F.col("fold_return") > 0).cast("double")).alias("fold_consistency"), F.avg("fold_return").alias("ret_avg"), F.stddev_pop("fold_return").alias("ret_std"),
        F.min("fold_return").alias("min_ret"), F.avg("fold_pf").alias("avg_pf"), F.stddev_pop("fold_wr").alias("wr_std"), F.sum("fold_return").alias("total_return"),
    )
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    cv = F.when(F.abs("ret_avg") > 1e-9, F.col("ret_std") / F.abs("ret_avg")).otherwise(999.0)
    parts = 0.30 * F.col("fold_consistency") + 0.25 * F.greatest(F.lit(0.0), 1 - cv) + 0.20 * clip((F.col("min_ret") + 0.10) / 0.10) + 0.15 * clip((F.col("avg_pf") - 0.8) / 0.7) + 0.10 * F.greatest(F.lit(0.0), 1 - F.col("wr_std") / 0.15)
    out = out.withColumn("stability_score", F.round(parts * 100, 6))
    good = (F.col("stability_score") >= 60) & (F.col("fold_consistency") >= 0.6) & (F.col("total_return") > 0)
    return out.withColumns({
        "status": F.when(good, "STABLE").when((F.col("stability_score") >= 40) & (F.col("total_return") > 0), "MARGINAL").otherwise("UNSTABLE"),
        "verdict": F.when(good, "PASS").when(F.col("total_return") > 0, "WARN").otherwise("FAIL"),
    })

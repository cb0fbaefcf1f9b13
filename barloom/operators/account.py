"""Replays of account rules over ordered trades, by window functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.running import before, blocked, blocks_before, so_far


def replay(trades: DataFrame, keys: Sequence[str], order: Sequence[str], day: Column, pnl_usd: Column | dict, daily_loss: float, total_loss: float, target: float, min_days: int, case: str | None = None) -> DataFrame:
    """The rules played through once for each key.

    A day's trades after one at which the day has lost daily_loss are skipped; this is decided
    inside each day first. The account then stops at the first trade taken at which it has lost
    total_loss, or gained target on min_days days. Money is compared after rounding to 1e-6.

    case names one more key, whose values (62 at most) are those of the dict pnl_usd with the money of each: a trade is
    one row, with a column for each case, until the account has stopped or the days are summed.
    """
    loss = F.lit(float(daily_loss))
    labels, money = (list(pnl_usd), list(pnl_usd.values())) if case else ([None], [pnl_usd])
    each = range(len(money))
    rows = trades.withColumn("_day", day)
    in_day = Window.partitionBy(*keys, "_day").orderBy(*order)
    rows = rows.withColumns({f"_in_day{i}": F.round(F.sum(money[i]).over(in_day.rowsBetween(Window.unboundedPreceding, 0)), 6) for i in each})
    rows = rows.withColumns({f"_open{i}": F.coalesce(F.min(f"_in_day{i}").over(in_day.rowsBetween(Window.unboundedPreceding, -1)) > -loss, F.lit(True)) for i in each})
    # One number tells the cases that are open; money is worked out anew beyond the exchange.
    rows = rows.withColumn("_bits", sum((F.when(F.col(f"_open{i}"), F.lit(1 << i).cast("long")).otherwise(0) for i in each), F.lit(0).cast("long")))
    rows = rows.withColumn("_first", (F.row_number().over(in_day) == 1).cast("int")).drop(*(f"_{c}{i}" for c in ("in_day", "open") for i in each))
    # The account's sums by blocks of the order, then whether it has stopped: no task holds a key.
    # The day ends the order, so that both steps need the same columns and share one exchange.
    w, past = so_far([*order, "_day"]), before(keys)
    rows = blocked(rows, keys, order)
    is_open = [F.col("_bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0 for i in each]
    own = [F.when(is_open[i], money[i]).otherwise(0.0) for i in each]
    facts = rows.groupBy("_g").agg(*(F.sum(own[i]).alias(f"_eq0{i}") for i in each), F.sum("_first").alias("_days0"))
    rows = blocks_before(rows, facts.select("_g", *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in (*(f"_eq0{i}" for i in each), "_days0"))))
    rows = rows.withColumns({f"_eq{i}": F.round(F.sum(own[i]).over(w) + F.col(f"_eq0{i}"), 6) for i in each} | {"_days": F.sum("_first").over(w) + F.col("_days0")})
    bust, won = ([F.col(f"_eq{i}") <= -total_loss for i in each], [(F.col(f"_eq{i}") >= target) & (F.col("_days") >= min_days) for i in each])
    rows = rows.withColumns({f"_stop{i}": F.when(is_open[i] & bust[i], 1).when(is_open[i] & won[i], 2).otherwise(0) for i in each})
    stops = rows.groupBy("_g").agg(*(F.max(f"_stop{i}").alias(f"_stop0{i}") for i in each))
    rows = blocks_before(rows, stops.select("_g", *(F.coalesce(F.max(c).over(past), F.lit(0)).alias(c) for c in (f"_stop0{i}" for i in each))))
    going = [F.col(f"_stop0{i}") == 0 for i in each]
    rows = rows.where(reduce(Column.__or__, going))
    rows = rows.withColumns({f"_before{i}": F.coalesce(F.max(f"_stop{i}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for i in each})
    facts_of = [F.struct(F.lit(labels[i]).alias("case"), is_open[i].alias("_open"), money[i].alias("_pnl"), F.col(f"_eq{i}").alias("_eq"), F.col(f"_stop{i}").alias("_stop"), (going[i] & (F.col(f"_before{i}") == 0)).alias("live")) for i in each]
    live = rows.select("_g", "_day", "_days", F.explode(F.array(*facts_of)).alias("_x")).where("_x.live")
    live = live.select(*(F.col("_g")[k].alias(k) for k in keys), *([F.col("_x.case").alias(case)] if case else []), "_day", "_days", "_x._open", "_x._pnl", "_x._eq", "_x._stop")
    keys = [*keys, case] if case else keys
    taken = F.col("_open")
    win = taken & (F.col("_pnl") > 0)
    # By day, then by key: the chain of windows runs once.
    days = live.groupBy(*keys, "_day").agg(
        F.count_if(taken).alias("taken"), F.count_if(~taken).alias("skipped"), F.count_if(win).alias("wins"), F.sum(F.when(win, F.col("_pnl")).otherwise(0.0)).alias("_won"), F.sum(F.when(taken & ~win, -F.col("_pnl")).otherwise(0.0)).alias("_lost"),
        F.sum(F.when(taken, F.col("_pnl"))).alias("_d"), F.min("_eq").alias("_least"), F.max("_days").alias("_n"), F.max(F.when(F.col("_stop") == 1, 1).otherwise(0)).alias("_bust"), F.max(F.when(F.col("_stop") == 2, 1).otherwise(0)).alias("_won_it"),
    )
    out = days.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("taken", "skipped", "wins", "_won", "_lost")], F.coalesce(F.sum("_d"), F.lit(0.0)).alias("final_pnl"), F.least(F.lit(0.0), F.min("_least")).alias("max_loss"),
        F.max("_n").alias("trading_days"), F.max("_bust").alias("_bust"), F.max("_won_it").alias("_won_it"), F.least(F.lit(0.0), F.min(F.round("_d", 6))).alias("worst_day"),
    )
    rate = F.try_divide("wins", "taken")
    payoff = F.try_divide(F.try_divide("_won", "wins"), F.try_divide("_lost", F.col("taken") - F.col("wins")))
    out = out.withColumns({
        "win_rate": F.coalesce(rate, F.lit(0.0)), "payoff": F.coalesce(payoff, F.lit(0.0)), "violated_daily": F.col("worst_day") <= -loss,
        "violated_total": F.col("_bust") == 1, "target_reached": F.col("_won_it") == 1,
    })
    rules = (F.col("trading_days") >= min_days, F.col("worst_day") > -loss, F.col("max_loss") > -total_loss, F.col("target_reached"))
    discipline = sum((r.cast("int") for r in rules), F.lit(0)) * 25
    return out.withColumn("discipline", discipline).drop("_won", "_lost", "_bust", "_won_it")


REPLAY_FIELDS = ("violated_total", "target_reached", "violated_daily", "final_pnl")


def replay_days(pnl: np.ndarray, daily_loss: float, total_loss: float, target: float, min_days: int) -> tuple[float, float, float, float]:
    """replay() of one account whose days have one result each: REPLAY_FIELDS, flags as 0 or 1."""
    equity = np.round(np.cumsum(pnl), 6)
    bust = equity <= -total_loss
    stop = bust | (equity >= target) & (np.arange(len(pnl)) + 1 >= min_days)
    end = int(np.argmax(stop)) + 1 if stop.any() else len(pnl)
    over = bool(stop[end - 1]) if end else False
    lost = bool(over and bust[end - 1])
    taken = pnl[:end]
    return float(lost), float(over and not lost), float(bool((np.round(taken, 6) <= -daily_loss).any())), float(taken.sum())


def daily_overlay(trades: DataFrame, keys: Sequence[str], order: Sequence[str], day: Column, pnl: Column, most: int = 8, loss: float = -0.05, profit: float = 0.08) -> DataFrame:
    """Each day's trades up to the first at which the day has had its most trades, or has lost or gained enough."""
    w = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = trades.withColumns({"_day": day, "_p": pnl})
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_c": F.round(F.coalesce(F.sum("_p").over(w), F.lit(0.0)), 9)})
    rows = rows.withColumn("_breach", ((F.col("_n") >= most) | (F.col("_c") <= loss) | (F.col("_c") >= profit)).cast("int"))
    upto = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_stopped", F.max("_breach").over(upto)).where("_stopped = 0").drop("_day", "_p", "_n", "_c", "_breach", "_stopped")


def notional(trades: DataFrame, keys: Sequence[str], risk_usd: float, pnl: str = "net_pnl_base", floor: float = 1e-8, fallback: float = 0.003) -> DataFrame:
    """Position in money: risk over the median loss of stopped trades, else of losers, else the fallback."""
    loss = F.coalesce(F.median(F.when((F.col("exit_reason") == "SL") & (F.col(pnl) < 0), -F.col(pnl))), F.median(F.when(F.col(pnl) < 0, -F.col(pnl))), F.lit(fallback))
    out = trades.groupBy(*keys).agg(loss.alias("sl_loss"))
    return out.withColumn("notional", risk_usd / F.greatest(F.lit(floor), F.col("sl_loss"))).withColumn("sane", F.col("sl_loss") <= 0.05)

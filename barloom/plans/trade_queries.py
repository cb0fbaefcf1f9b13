"""Queries over signals, exits, sweeps, account rules and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import costs as C
from barloom.operators import account as K
from barloom.operators import features as W
from barloom.operators import folds as O
from barloom.operators import metrics as M
from barloom.operators import trades as T
from barloom.operators.running import dealt
from barloom.plans.bar_queries import DAY, EP, day, ep
from barloom.plans.feature_queries import FEAT, TAGGED, THR
from barloom.plans.registry import query
from barloom.scratch import scratch_folder
from barloom.sources import fixtures as X
from barloom.sources.bars import daily_close
from barloom.sources.fixtures import SQL_BARS, SQL_FOLDS, SQL_TRADES, TRADE_ORDER

ORDER = ", ".join(TRADE_ORDER)


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Every bar that closes higher (LONG) or lower (SHORT) than the one before."""
    rows = W.returns(X.bars(spark, folder)).where("prev_close is not null and close <> prev_close")
    return rows.withColumn("side", F.when(F.col("close") > F.col("prev_close"), "LONG").otherwise("SHORT"))


SQL_SIGNALS = SQL_BARS + """,
sig AS (SELECT *, CASE WHEN close > prev_close THEN 'LONG' ELSE 'SHORT' END AS side FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time_utc) AS prev_close FROM bars) WHERE prev_close IS NOT NULL AND close <> prev_close)"""  # fmt: skip
SIGN = "CASE WHEN side = 'SHORT' THEN -1 ELSE 1 END"

NEXT = SQL_BARS + f""",
nx AS (SELECT *, lead(open, 1) OVER w AS entry_price, lead(open, 2) OVER w AS exit_price, lead(time_utc, 1) OVER w AS entry_time, lead(time_utc, 2) OVER w AS exit_time, CASE WHEN close >= 115 THEN 'LONG' ELSE 'SHORT' END AS side FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time_utc)),
nxr AS (SELECT *, {SIGN} * (exit_price / entry_price - 1) AS gross_ret FROM nx WHERE entry_price > 0 AND exit_price > 0)"""  # fmt: skip


def next_bar(spark, folder) -> DataFrame:
    rows = X.bars(spark, folder).withColumn("side", F.when(F.col("close") >= 115, "LONG").otherwise("SHORT"))
    return T.next_bar_returns(rows, F.lit(0.0003), F.lit(0.0006))


@query("W13_next_bar_execution", NEXT, sql=f"SELECT symbol, {EP} AS t, side, CAST(epoch(entry_time) AS BIGINT) AS entry_t, CAST(epoch(exit_time) AS BIGINT) AS exit_t, round(gross_ret, 9) AS gross_ret, round(gross_ret - 0.0003, 9) AS net_ret_base, round(gross_ret - 0.0006, 9) AS net_ret_stress FROM nxr")
def w13(spark, folder):
    return next_bar(spark, folder).select("symbol", ep("time_utc").alias("t"), "side", ep("entry_time").alias("entry_t"), ep("exit_time").alias("exit_t"), *[F.round(c, 9).alias(c) for c in ("gross_ret", "net_ret_base", "net_ret_stress")])


@query("P8_positive_prices", NEXT, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM nxr GROUP BY symbol")
def p8(spark, folder):
    return next_bar(spark, folder).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("J6_clock_forward_returns", SQL_SIGNALS, sql=f"SELECT s.symbol, CAST(epoch(s.time_utc) AS BIGINT) AS t, side, CAST(h AS INT) AS horizon, round({SIGN} * (b.close / s.close - 1), 9) AS fwd_ret FROM sig s CROSS JOIN (SELECT unnest([1, 3, 6, 12]) AS h) LEFT JOIN bars b ON b.symbol = s.symbol AND b.time_utc = s.time_utc + to_hours(CAST(h AS INT))")
def j6(spark, folder):
    rows = T.clock_returns(signals(spark, folder), X.bars(spark, folder), (1, 3, 6, 12), 3600)
    return rows.select("symbol", ep("time_utc").alias("t"), "side", "horizon", F.round("fwd_ret", 9).alias("fwd_ret"))


@query("J7_signal_bar_lookup", SQL_SIGNALS, sql="SELECT s.symbol, CAST(epoch(s.time_utc) AS BIGINT) AS t, b.high, b.volume FROM sig s LEFT JOIN bars b ON b.symbol = s.symbol AND b.time_utc = s.time_utc")
def j7(spark, folder):
    bars = X.bars(spark, folder).select("symbol", "time_utc", "high", "volume")
    return signals(spark, folder).select("symbol", "time_utc").join(bars, ["symbol", "time_utc"], "left").select("symbol", ep("time_utc").alias("t"), "high", "volume")


ALPHA = SQL_SIGNALS + ",\n" + SQL_FOLDS + ",\n" + TAGGED + f""",
fw AS (SELECT s.*, """ + ", ".join(f"{SIGN} * (lead(close, {h}) OVER w / close - 1) AS fwd_{h}" for h in (1, 3, 6)) + """ FROM (SELECT *, CASE WHEN close >= 115 THEN 'LONG' ELSE 'SHORT' END AS side FROM bars) s WINDOW w AS (PARTITION BY symbol ORDER BY time_utc)),
tag AS (SELECT fw.*, fold_id, segment FROM fw JOIN parts ON parts.symbol = fw.symbol AND time_utc >= a AND time_utc <= b),
rep AS (SELECT symbol, fold_id, side, segment, h AS horizon, count(r) AS n, avg(r) AS mean_ret, stddev_samp(r) AS std_ret, avg(CAST(r > 0 AS DOUBLE)) AS win_rate FROM (SELECT symbol, fold_id, side, segment, unnest([1, 3, 6]) AS h, unnest([fwd_1, fwd_3, fwd_6]) AS r FROM tag) WHERE r IS NOT NULL GROUP BY ALL HAVING count(r) >= 5)"""  # fmt: skip


def report(spark, folder) -> DataFrame:
    rows = X.bars(spark, folder).withColumn("side", F.when(F.col("close") >= 115, "LONG").otherwise("SHORT"))
    rows = W.forward_returns(rows, (1, 3, 6), F.col("side"))
    return M.alpha_report(O.tag_segments(rows, X.folds(spark, folder), "time_utc"), (1, 3, 6), 0.0003, 0.0006)


@query("A23_alpha_report", ALPHA, sql="SELECT symbol, fold_id, side, segment, CAST(horizon AS INT) AS horizon, CAST(n AS BIGINT) AS n, round(mean_ret, 9) AS mean_ret, round(std_ret, 9) AS std_ret, round(win_rate, 9) AS win_rate, round(mean_ret - 0.0003, 9) AS net_base, round(mean_ret - 0.0006, 9) AS net_stress, round(mean_ret / std_ret, 6) AS sharpe_like FROM rep")
def a23(spark, folder):
    return report(spark, folder).select("symbol", "fold_id", "side", "segment", "horizon", "n", *[F.round(c, 9).alias(c) for c in ("mean_ret", "std_ret", "win_rate", "net_base", "net_stress")], F.round("sharpe_like", 6).alias("sharpe_like"))


@query("A31_alpha_design", ALPHA, sql="SELECT symbol, side, fold_id, segment, CAST(horizon AS INT) AS horizon, round(score, 6) AS score, CAST(horizon AS INT) AS time_stop, CAST(greatest(6, floor(0.25::DOUBLE * horizon)) AS INT) AS min_hold_bars, CAST(greatest(3, floor(0.1::DOUBLE * horizon)) AS INT) AS confirm_bars FROM (SELECT *, mean_ret / std_ret * sqrt(n) AS score, row_number() OVER (PARTITION BY symbol, side ORDER BY round(mean_ret / std_ret * sqrt(n), 9) DESC, horizon, fold_id, segment) AS rn FROM rep WHERE n >= 10 AND mean_ret - 0.0003 >= 0) WHERE rn = 1")
def a31(spark, folder):
    rows = M.alpha_design(report(spark, folder), 10)
    return rows.select("symbol", "side", "fold_id", "segment", "horizon", F.round("score", 6).alias("score"), "time_stop", "min_hold_bars", "confirm_bars")


@query("A28_best_horizon", ALPHA, sql="SELECT symbol, fold_id, side, segment, CAST(arg_max(horizon, (round(mean_ret, 12), -horizon)) AS INT) AS best_horizon, max(round(mean_ret, 12)) AS best_mean FROM rep GROUP BY symbol, fold_id, side, segment")
def a28(spark, folder):
    return M.best_horizon(report(spark, folder), ["symbol", "fold_id", "side", "segment"])


@query("A27_edge_summary", SQL_TRADES, sql="""SELECT side, symbol, regime, segment, CAST(count(*) AS BIGINT) AS n, round(avg(gross_pnl), 9) AS mean_ret, round(median(gross_pnl), 9) AS median_ret, round(100 * avg(CAST(gross_pnl > 0 AS DOUBLE)), 6) AS positive_pct, round(avg(gross_pnl) / stddev_samp(gross_pnl) * sqrt(252 * 288 / 24.0::DOUBLE), 6) AS sharpe
FROM (SELECT *, CASE WHEN hold_bars <= 72 THEN 'low' WHEN hold_bars <= 120 THEN 'mid' ELSE 'high' END AS regime FROM trades) GROUP BY GROUPING SETS ((), (side), (symbol, side), (regime), (segment))""")
def a27(spark, folder):
    rows = X.trades(spark, folder).withColumn("regime", F.when(F.col("hold_bars") <= 72, "low").when(F.col("hold_bars") <= 120, "mid").otherwise("high"))
    out = M.edge_summary(rows, "gross_pnl", 24)
    return out.select("side", "symbol", "regime", "segment", "n", F.round("mean_ret", 9).alias("mean_ret"), F.round("median_ret", 9).alias("median_ret"), F.round("positive_pct", 6).alias("positive_pct"), F.round("sharpe", 6).alias("sharpe"))


@query("J13_decay_table", SQL_TRADES, sql="SELECT symbol, fold_id, round(edge_is, 9) AS edge_is, round(edge_oos, 9) AS edge_oos, round(CASE WHEN abs(edge_is) > 0.01 THEN (edge_oos - edge_is) / abs(edge_is) * 100 ELSE 0 END, 6) AS decay_pct FROM (SELECT symbol, fold_id, round(100 * avg(gross_pnl) FILTER (segment = 'IS'), 9) AS edge_is, round(100 * avg(gross_pnl) FILTER (segment = 'OOS'), 9) AS edge_oos FROM trades GROUP BY ALL) WHERE edge_is IS NOT NULL AND edge_oos IS NOT NULL ORDER BY edge_oos DESC, symbol, fold_id LIMIT 20")
def j13(spark, folder):
    rows = X.trades(spark, folder).groupBy("symbol", "fold_id", "segment").agg(F.round(100 * F.avg("gross_pnl"), 9).alias("edge"))
    out = M.decay_table(rows, ("symbol", "fold_id"))
    return out.select("symbol", "fold_id", *[F.round(c, d).alias(c) for c, d in (("edge_is", 9), ("edge_oos", 9), ("decay_pct", 6))])


STOP, HOLD, OFF, COOL = 12, 3, 2, 2


def prepared(spark, folder) -> DataFrame:
    """Numbered bars with gates (close above or below the one before), two confirming bars, atr = 1 % of the close."""
    rows = W.returns(X.bars(spark, folder)).withColumns({"gate_long": F.coalesce(F.col("close") > F.col("prev_close"), F.lit(False)), "gate_short": F.coalesce(F.col("close") < F.col("prev_close"), F.lit(False)), "atr": F.round(F.col("close") * 0.01, 6)})
    return T.number_bars(W.streak(W.streak(rows, "gate_long", 2, "conf_long"), "gate_short", 2, "conf_short"))


def entries(spark, folder) -> DataFrame:
    return T.candidates(prepared(spark, folder))


def grid(spark) -> DataFrame:
    return T.parameter_grid(spark, (2.0, 4.0), (3.0, 6.0), (0.0, 3.0))


PREPARED = SQL_BARS + """,
pr0 AS (SELECT *, coalesce(close > pc, false) AS gate_long, coalesce(close < pc, false) AS gate_short, round(close * 0.01, 6) AS atr FROM (SELECT *, lag(close) OVER w AS pc, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n, lead(open) OVER w AS next_open, isodow(time_utc) >= 6 AS weekend, coalesce(isodow(lead(time_utc) OVER w) >= 6, false) AS next_weekend FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time_utc))),
prep AS (SELECT *, gate_long AND coalesce(lag(gate_long) OVER w, false) AS conf_long, gate_short AND coalesce(lag(gate_short) OVER w, false) AS conf_short FROM pr0 WINDOW w AS (PARTITION BY symbol ORDER BY time_utc)),
cand AS (SELECT symbol, idx AS i, time_utc AS signal_time, CASE WHEN conf_long THEN 'LONG' ELSE 'SHORT' END AS side, next_open AS entry_price, atr FROM prep WHERE (conf_long OR conf_short) AND idx < n - 2 AND atr > 0 AND NOT weekend AND NOT next_weekend),
grid AS (SELECT row_number() OVER (ORDER BY sl, tp, trail) - 1 AS combo, sl, tp, trail FROM (SELECT unnest([2.0::DOUBLE, 4.0]) AS sl), (SELECT unnest([3.0::DOUBLE, 6.0]) AS tp), (SELECT unnest([0.0::DOUBLE, 3.0]) AS trail) WHERE trail = 0 OR trail > sl)"""  # fmt: skip
LABELS = PREPARED + f""",
pth AS (SELECT c.*, combo, sl, tp, trail, CASE WHEN side = 'LONG' THEN 1 ELSE -1 END AS s, b.idx AS j, b.time_utc AS exit_time, b.high, b.low, b.close, b.weekend,
  CASE WHEN side = 'LONG' THEN greatest(entry_price, max(b.high) OVER w) ELSE least(entry_price, min(b.low) OVER w) END AS best,
  b.idx - coalesce(max(CASE WHEN CASE WHEN side = 'LONG' THEN b.gate_long ELSE b.gate_short END THEN b.idx END) OVER w, i) AS off
  FROM cand c CROSS JOIN grid g JOIN prep b ON b.symbol = c.symbol AND b.idx > c.i AND b.idx <= c.i + {STOP} WINDOW w AS (PARTITION BY c.symbol, combo, c.i ORDER BY b.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
evt AS (SELECT *, CASE WHEN CASE WHEN s = 1 THEN low <= entry_price - s * sl * atr ELSE high >= entry_price - s * sl * atr END THEN 0
  WHEN trail > 0 AND CASE WHEN s = 1 THEN low <= best - s * trail * atr ELSE high >= best - s * trail * atr END THEN 1
  WHEN CASE WHEN s = 1 THEN high >= entry_price + s * tp * atr ELSE low <= entry_price + s * tp * atr END THEN 2
  WHEN j - i >= {STOP} THEN 3 WHEN j - i >= {HOLD} AND off >= {OFF} THEN 4 WHEN weekend THEN 5 END AS k FROM pth),
lab AS (SELECT symbol, combo, i, side, signal_time, entry_price, j AS exit_idx, exit_time, ['SL', 'TRAIL', 'TP', 'TIME', 'REGIME_OFF', 'WEEKEND'][k + 1] AS exit_reason,
  CASE k WHEN 0 THEN entry_price - s * sl * atr WHEN 1 THEN best - s * trail * atr WHEN 2 THEN entry_price + s * tp * atr ELSE close END AS exit_price, j - i AS hold_bars,
  s * (CASE k WHEN 0 THEN entry_price - s * sl * atr WHEN 1 THEN best - s * trail * atr WHEN 2 THEN entry_price + s * tp * atr ELSE close END / entry_price - 1) AS gross_pnl
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, combo, i ORDER BY j) AS rn FROM evt WHERE k IS NOT NULL) WHERE rn = 1)"""  # fmt: skip


def labelled(spark, folder) -> DataFrame:
    rows = entries(spark, folder).join(F.broadcast(grid(spark)))
    return T.label_exits(rows, prepared(spark, folder), STOP, HOLD, OFF, keys=("combo", "sl", "tp", "trail"))


@query("J9_parameter_grid", PREPARED, SQL_FOLDS, sql="SELECT symbol, fold_id, CAST(combo AS INT) AS combo, sl, tp, trail FROM grid, folds WHERE combo < 5")
def j9(spark, folder):
    few = T.parameter_grid(spark, (2.0, 4.0), (3.0, 6.0), (0.0, 3.0), most=5)
    return X.folds(spark, folder).join(F.broadcast(few)).select("symbol", "fold_id", "combo", "sl", "tp", "trail")


@query("T9_weekend_rules", PREPARED, sql="SELECT symbol, side, CAST(count(*) AS BIGINT) AS n FROM cand GROUP BY ALL")
def t9(spark, folder):
    return entries(spark, folder).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"))


@query("T6_barrier_exits", LABELS, sql="SELECT symbol, CAST(combo AS INT) AS combo, CAST(i AS INT) AS i, side, exit_reason, CAST(hold_bars AS INT) AS hold_bars, round(exit_price, 6) AS exit_price, round(gross_pnl, 9) AS gross_pnl FROM lab")
def t6(spark, folder):
    return labelled(spark, folder).select("symbol", "combo", "i", "side", "exit_reason", "hold_bars", F.round("exit_price", 6).alias("exit_price"), F.round("gross_pnl", 9).alias("gross_pnl"))


CHAIN = LABELS.replace("ticks AS", "RECURSIVE ticks AS", 1) + f""",
chain AS (SELECT symbol, combo, min(i) AS i FROM lab GROUP BY symbol, combo
  UNION ALL SELECT c.symbol, c.combo, (SELECT min(n.i) FROM lab n WHERE n.symbol = c.symbol AND n.combo = c.combo AND n.i >= l.exit_idx + {COOL} + 1) FROM chain c JOIN lab l ON l.symbol = c.symbol AND l.combo = c.combo AND l.i = c.i
  WHERE EXISTS (SELECT 1 FROM lab n WHERE n.symbol = c.symbol AND n.combo = c.combo AND n.i >= l.exit_idx + {COOL} + 1))"""  # fmt: skip


@query("T7_non_overlap", CHAIN, sql="SELECT symbol, CAST(combo AS INT) AS combo, CAST(i AS INT) AS i, exit_reason FROM lab JOIN chain USING (symbol, combo, i)")
def t7(spark, folder):
    return T.without_overlap(labelled(spark, folder), COOL, ("symbol", "combo")).select("symbol", "combo", "i", "exit_reason")


@query("J14_next_match", LABELS, sql=f"SELECT l.symbol, CAST(l.exit_idx AS INT) AS exit_idx, CAST(coalesce((SELECT min(c.i) FROM cand c WHERE c.symbol = l.symbol AND c.i >= l.exit_idx + {COOL} + 1), -1) AS INT) AS next_i FROM (SELECT DISTINCT symbol, exit_idx FROM lab) l")
def j14(spark, folder):
    exits = labelled(spark, folder).select("symbol", "exit_idx").distinct()
    return T.next_match(exits, entries(spark, folder), COOL).select("symbol", "exit_idx", F.coalesce("next_i", F.lit(-1)).alias("next_i"))


SWEEP = CHAIN[: CHAIN.index(",\nchain AS")] + ",\n" + SQL_FOLDS + ",\n" + TAGGED + f""",
st AS (SELECT lab.*, fold_id, segment FROM lab JOIN parts ON parts.symbol = lab.symbol AND signal_time >= a AND signal_time <= b AND exit_time <= b),
sc AS (SELECT symbol, fold_id, segment, combo, min(i) AS i FROM st GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT c.symbol, c.fold_id, c.segment, c.combo, (SELECT min(n.i) FROM st n WHERE n.symbol = c.symbol AND n.fold_id = c.fold_id AND n.segment = c.segment AND n.combo = c.combo AND n.i >= l.exit_idx + {COOL} + 1) AS i FROM sc c JOIN st l USING (symbol, fold_id, segment, combo, i)) WHERE i IS NOT NULL),
swp AS (SELECT st.* FROM st JOIN sc USING (symbol, fold_id, segment, combo, i)),
tun AS (SELECT symbol, fold_id, combo, count(*) AS n_trades, sum(gross_pnl - 0.001) AS sum_ret, coalesce(stddev_samp(gross_pnl - 0.001), 0) AS std_ret, avg(gross_pnl - 0.001) AS mean_ret, sum(gross_pnl - 0.001) / greatest(1e-12, coalesce(stddev_samp(gross_pnl - 0.001), 0)) AS score FROM swp WHERE segment = 'IS' GROUP BY ALL HAVING count(*) >= 3),
bst AS (SELECT symbol, fold_id, combo FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold_id ORDER BY round(score, 9) DESC, combo) AS rn FROM tun) WHERE rn = 1)"""  # fmt: skip


def swept(spark, folder) -> DataFrame:
    return T.sweep(entries(spark, folder), prepared(spark, folder), X.folds(spark, folder), grid(spark), STOP, HOLD, OFF, COOL)


def tuned(spark, folder) -> DataFrame:
    return T.tuning(swept(spark, folder), 0.001, 3)


@query("T8_segment_of_trades", LABELS, SQL_FOLDS, TAGGED, sql="SELECT lab.symbol, fold_id, segment, CAST(count(*) AS BIGINT) AS n FROM lab JOIN parts ON parts.symbol = lab.symbol AND signal_time >= a AND signal_time <= b GROUP BY ALL")
def t8(spark, folder):
    return O.tag_segments(labelled(spark, folder), X.folds(spark, folder), "signal_time").groupBy("symbol", "fold_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("T15_parameter_sweep", SWEEP, sql="SELECT symbol, fold_id, CAST(combo AS INT) AS combo, CAST(n_trades AS BIGINT) AS n_trades, round(sum_ret, 9) AS sum_ret, round(std_ret, 9) AS std_ret, round(mean_ret, 9) AS mean_ret, round(score, 6) AS score FROM tun")
def t15(spark, folder):
    return tuned(spark, folder).select("symbol", "fold_id", "combo", "n_trades", *[F.round(c, 9).alias(c) for c in ("sum_ret", "std_ret", "mean_ret")], F.round("score", 6).alias("score"))


@query("A30_best_per_group", SWEEP, sql="SELECT symbol, fold_id, CAST(combo AS INT) AS combo FROM bst")
def a30(spark, folder):
    return T.best_of(tuned(spark, folder), ["symbol", "fold_id"], F.round("score", 9).desc(), F.col("combo")).select("symbol", "fold_id", "combo")


@query("T16_walk_forward", SWEEP, sql="SELECT symbol, fold_id, CAST(combo AS INT) AS combo, CAST(i AS INT) AS i, exit_reason, round(gross_pnl, 9) AS gross_pnl FROM swp JOIN bst USING (symbol, fold_id, combo) WHERE segment = 'OOS'")
def t16(spark, folder):
    rows = swept(spark, folder)
    return T.walk_forward(rows, T.tuning(rows, 0.001, 3)).select("symbol", "fold_id", "combo", "i", "exit_reason", F.round("gross_pnl", 9).alias("gross_pnl"))


@query("A32_score_counts", SWEEP, sql="SELECT symbol, fold_id, CAST(count(DISTINCT round(score, 6)) AS BIGINT) AS scores, CAST(count(*) AS BIGINT) AS combos, count(DISTINCT round(score, 6)) > 1 OR count(*) < 2 AS varies FROM tun GROUP BY ALL")
def a32(spark, folder):
    return M.score_counts(tuned(spark, folder).withColumn("score", F.round("score", 6)))


@query("A33_modal_parameters", SWEEP, sql="SELECT symbol, CAST(combo AS INT) AS combo, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, first) AS rn FROM (SELECT symbol, combo, count(*) AS n, min(fold_id) AS first FROM bst GROUP BY ALL)) WHERE rn = 1")
def a33(spark, folder):
    best = T.best_of(tuned(spark, folder), ["symbol", "fold_id"], F.round("score", 9).desc(), F.col("combo"))
    return T.modal_parameters(best)


@query("M12_overfit_by_rank", SWEEP, sql="SELECT CAST(count(*) AS BIGINT) AS n_folds, CAST(count(*) FILTER (o < mid) AS BIGINT) AS n_over, count(*) FILTER (o < mid) / count(*) AS pbo FROM (SELECT k, arg_min(o, (-s, combo)) AS o, median(o) AS mid FROM (SELECT symbol || fold_id AS k, combo, round(score, 9) AS s, (SELECT coalesce(sum(gross_pnl), 0) FROM swp w WHERE w.segment = 'OOS' AND w.symbol = tun.symbol AND w.fold_id = tun.fold_id AND w.combo = tun.combo) AS o FROM tun) GROUP BY k)")
def m12_rank(spark, folder):
    from barloom.operators.stats import overfit_by_rank

    rows = swept(spark, folder)
    oos = rows.where("segment = 'OOS'").groupBy("symbol", "fold_id", "combo").agg(F.sum("gross_pnl").alias("oos_score"))
    scores = T.tuning(rows, 0.001, 3).join(oos.hint("shuffle_merge"), ["symbol", "fold_id", "combo"], "left").select(F.concat("symbol", "fold_id").alias("fold_id"), "combo", F.col("score").alias("is_score"), F.coalesce("oos_score", F.lit(0.0)).alias("oos_score"))
    return overfit_by_rank(scores).select("n_folds", "n_over", "pbo")


SELECTED = SQL_TRADES + f""",
eq AS (SELECT *, cum - max(cum) OVER w AS dd FROM (SELECT *, sum(net_pnl_base) OVER w AS cum FROM trades WHERE segment = 'OOS' WINDOW w AS (PARTITION BY symbol, side ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WINDOW w AS (PARTITION BY symbol, side ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sl0 AS (SELECT symbol, side, count(*) AS n_oos, sum(net_pnl_base) AS tot_ret, avg(CAST(net_pnl_base > 0 AS DOUBLE)) AS win_rate, min(dd) AS mdd, avg(net_pnl_base) / greatest(1e-12, stddev_samp(net_pnl_base)) AS sharpe FROM eq GROUP BY ALL),
sel AS (SELECT *, tot_ret + 0.15 * sharpe + 0.05 * (win_rate - 0.5) - 1.25 * -mdd - 0.125 AS score, CASE WHEN n_oos >= 20 AND tot_ret >= -60 AND mdd >= -70 AND win_rate >= 0.10 THEN 'GO' ELSE 'NO_GO' END AS decision FROM sl0)"""  # fmt: skip


def selected(spark, folder) -> DataFrame:
    return T.selection(X.trades(spark, folder).where("segment = 'OOS'"), TRADE_ORDER, 20, -60, -70, 0.10)


@query("T18_selection", SELECTED, sql="SELECT symbol, side, CAST(n_oos AS BIGINT) AS n_oos, round(tot_ret, 4) AS tot_ret, round(win_rate, 6) AS win_rate, round(mdd, 4) AS mdd, round(sharpe, 6) AS sharpe, round(score, 4) AS score, decision FROM sel")
def t18(spark, folder):
    return selected(spark, folder).select("symbol", "side", "n_oos", F.round("tot_ret", 4).alias("tot_ret"), F.round("win_rate", 6).alias("win_rate"), F.round("mdd", 4).alias("mdd"), F.round("sharpe", 6).alias("sharpe"), F.round("score", 4).alias("score"), "decision")


@query("L3_go_or_best", SELECTED, sql="SELECT symbol, side FROM (SELECT *, count(*) FILTER (decision = 'GO') OVER () AS g, row_number() OVER (ORDER BY round(score, 9) DESC, symbol, side) AS rn FROM sel) WHERE CASE WHEN g > 0 THEN decision = 'GO' ELSE rn <= 2 END")
def l3(spark, folder):
    return T.go_or_best(selected(spark, folder)).select("symbol", "side")


@query("P15_selected_pairs", SELECTED, sql="SELECT symbol, side, CAST(count(*) AS BIGINT) AS n FROM trades WHERE (symbol, side) IN (SELECT (symbol, side) FROM sel WHERE decision = 'GO') GROUP BY ALL")
def p15(spark, folder):
    pairs = selected(spark, folder).where("decision = 'GO'").select("symbol", "side")
    return X.trades(spark, folder).join(pairs, ["symbol", "side"], "left_semi").groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"))


@query("S18_deploy_table", SELECTED, sql="""SELECT symbol, '[' || string_agg('{"side":"' || side || '","decision":"' || decision || '","n_oos":' || n_oos || '}', ',' ORDER BY side) || ']' AS gates FROM sel GROUP BY symbol""")
def s18(spark, folder):
    gates = F.array_sort(F.collect_list(F.struct("side", "decision", "n_oos")))
    return selected(spark, folder).groupBy("symbol").agg(F.to_json(gates).alias("gates"))


@query("L4_top_per_side", SELECTED, sql="SELECT symbol, side, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round(score, 9) DESC, symbol) AS rn FROM sel) WHERE rn <= 2")
def l4(spark, folder):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("side").orderBy(F.round("score", 9).desc(), "symbol"))
    return selected(spark, folder).withColumn("rn", rn).where("rn <= 2").select("symbol", "side", "rn")


@query("L1_global_sort", SQL_TRADES, sql="SELECT symbol, fold_id, CAST(count(*) AS BIGINT) AS n FROM trades GROUP BY ALL ORDER BY n DESC, symbol, fold_id")
def l1(spark, folder):
    return X.trades(spark, folder).groupBy("symbol", "fold_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "symbol", "fold_id")


@query("L2_best_and_worst_days", SQL_TRADES, sql="WITH d AS (SELECT CAST(epoch(date_trunc('day', exit_time)) AS BIGINT) AS d, round(sum(net_pnl_base), 6) AS pnl FROM trades GROUP BY 1) SELECT 'best' AS what, * FROM (SELECT * FROM d ORDER BY pnl DESC, d LIMIT 5) UNION ALL SELECT 'worst', * FROM (SELECT * FROM d ORDER BY pnl, d LIMIT 5)")
def l2(spark, folder):
    days = M.daily_pnl(X.trades(spark, folder), [], F.col("net_pnl_base")).select(day().alias("d"), F.round("pnl", 6).alias("pnl"))
    best = days.orderBy(F.col("pnl").desc(), "d").limit(5).select(F.lit("best").alias("what"), "d", "pnl")
    return best.unionByName(days.orderBy("pnl", "d").limit(5).select(F.lit("worst").alias("what"), "d", "pnl"))


@query("T19_trade_qa", SQL_TRADES, sql="SELECT CAST(count(*) AS BIGINT) AS n_trades, CAST(count(*) FILTER (entry_time <= signal_time) AS BIGINT) AS lookahead, CAST(count(*) FILTER (isodow(entry_time) >= 6) AS BIGINT) AS weekend_entries, CAST(count(*) FILTER (net_pnl_stress > net_pnl_base) AS BIGINT) AS stress_above_base, CAST(count(*) FILTER (exit_time <= entry_time) AS BIGINT) AS exit_before_entry, CAST(0 AS BIGINT) AS more_than_signals FROM trades")
def t19(spark, folder):
    return T.trade_qa(X.trades(spark, folder)).withColumn("more_than_signals", F.col("more_than_signals").cast("long"))


STABLE = SQL_TRADES + """,
fold AS (SELECT symbol, side, fold_id, sum(net_pnl_base) AS fold_return, avg(CAST(net_pnl_base > 0 AS DOUBLE)) AS fold_wr, coalesce(sum(net_pnl_base) FILTER (net_pnl_base > 0) / abs(sum(net_pnl_base) FILTER (net_pnl_base < 0)), 0) AS fold_pf FROM trades WHERE segment = 'OOS' GROUP BY ALL),
stab0 AS (SELECT symbol, side, count(*) AS n_folds, avg(CAST(fold_return > 0 AS DOUBLE)) AS fc, avg(fold_return) AS ra, stddev_pop(fold_return) AS rs, min(fold_return) AS mr, avg(fold_pf) AS pf, stddev_pop(fold_wr) AS ws, sum(fold_return) AS total_return FROM fold GROUP BY ALL),
stab AS (SELECT *, round(100 * (0.30 * fc + 0.25 * greatest(0, 1 - CASE WHEN abs(ra) > 1e-9 THEN rs / abs(ra) ELSE 999 END) + 0.20 * greatest(0, least(1, (mr + 0.10) / 0.10)) + 0.15 * greatest(0, least(1, (pf - 0.8) / 0.7)) + 0.10 * greatest(0, 1 - ws / 0.15)), 6) AS stability_score FROM stab0)"""  # fmt: skip


def stable(spark, folder) -> DataFrame:
    x = F.col("net_pnl_base")
    rows = X.trades(spark, folder).where("segment = 'OOS'").groupBy("symbol", "side", "fold_id").agg(F.sum(x).alias("fold_return"), F.avg((x > 0).cast("double")).alias("fold_wr"), M.profit_factor("net_pnl_base").alias("fold_pf"))
    return T.stability(rows)


@query("T21_stability", STABLE, sql="SELECT symbol, side, CAST(n_folds AS BIGINT) AS n_folds, round(fc, 6) AS fold_consistency, round(stability_score, 4) AS stability_score, CASE WHEN stability_score >= 60 AND fc >= 0.6 AND total_return > 0 THEN 'STABLE' WHEN stability_score >= 40 AND total_return > 0 THEN 'MARGINAL' ELSE 'UNSTABLE' END AS status, CASE WHEN stability_score >= 60 AND fc >= 0.6 AND total_return > 0 THEN 'PASS' WHEN total_return > 0 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM stab")
def t21(spark, folder):
    return stable(spark, folder).select("symbol", "side", "n_folds", F.round("fold_consistency", 6).alias("fold_consistency"), F.round("stability_score", 4).alias("stability_score"), "status", "verdict")


@query("P11_shortlist", SQL_TRADES, sql="SELECT symbol, side, fold_id, CAST(n AS BIGINT) AS n, round(edge, 9) AS edge FROM (SELECT symbol, side, fold_id, count(*) AS n, avg(gross_pnl) AS edge, avg(gross_pnl) / (stddev_samp(gross_pnl) / sqrt(count(*))) > 0.5 AS significant FROM trades WHERE segment = 'OOS' GROUP BY ALL) WHERE significant AND edge BETWEEN 0.00001 AND 0.01 AND n >= 50")
def p11(spark, folder):
    g = X.trades(spark, folder).where("segment = 'OOS'").groupBy("symbol", "side", "fold_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_pnl").alias("edge"), (F.try_divide(F.avg("gross_pnl"), F.stddev_samp("gross_pnl") / F.sqrt(F.count(F.lit(1)).cast("double"))) > 0.5).alias("significant"))
    return g.where(F.col("significant") & F.col("edge").between(0.00001, 0.01) & (F.col("n") >= 50)).select("symbol", "side", "fold_id", "n", F.round("edge", 9).alias("edge"))


@query("A29_class_rollup", SQL_TRADES, sql="SELECT asset_class, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (edge > 0) AS BIGINT) AS n_significant, round(avg(edge), 9) AS mean_edge, arg_max(symbol, (edge, symbol)) AS best FROM (SELECT side AS asset_class, symbol || fold_id AS symbol, round(avg(gross_pnl), 9) AS edge FROM trades GROUP BY side, symbol, fold_id) GROUP BY asset_class")
def a29(spark, folder):
    rows = X.trades(spark, folder).groupBy(F.col("side").alias("asset_class"), F.concat("symbol", "fold_id").alias("symbol")).agg(F.round(F.avg("gross_pnl"), 9).alias("edge")).withColumn("significant", F.col("edge") > 0)
    return M.class_rollup(rows).withColumn("mean_edge", F.round("mean_edge", 9))


@query("A41_side_mismatch", SQL_TRADES, sql="SELECT symbol, alpha_side, round(score, 9) AS score, traded_side, round(total, 6) AS total, alpha_side <> traded_side AS mismatch FROM (SELECT symbol, arg_max(side, (round(score, 9), side)) AS alpha_side, max(round(score, 9)) AS score FROM (SELECT symbol, side, avg(gross_pnl) AS score FROM trades WHERE segment = 'IS' GROUP BY ALL) GROUP BY symbol) JOIN (SELECT symbol, arg_max(side, (round(total, 9), side)) AS traded_side, max(round(total, 9)) AS total FROM (SELECT symbol, side, sum(net_pnl_base) AS total FROM trades WHERE segment = 'OOS' GROUP BY ALL) GROUP BY symbol) USING (symbol)")
def a41(spark, folder):
    t = X.trades(spark, folder)
    alpha = t.where("segment = 'IS'").groupBy("symbol", "side").agg(F.avg("gross_pnl").alias("score"))
    traded = t.where("segment = 'OOS'").groupBy("symbol", "side").agg(F.sum("net_pnl_base").alias("total"))
    return M.side_mismatch(alpha, traded).select("symbol", "alpha_side", F.round("score", 9).alias("score"), "traded_side", F.round("total", 6).alias("total"), "mismatch")


SCREENED = FEAT + f""",
tq AS (SELECT symbol AS s, {THR.format('er', 0.6)} AS a, {THR.format('mom_bps', 0.55)} AS b, {THR.format('vol_bps', 0.9)} AS d FROM feat GROUP BY symbol),
fw AS (SELECT symbol, time_utc, er >= a AND vol_bps <= d AND mom_bps >= b AS gate, {', '.join(f'lead(close, {h}) OVER w / close - 1 AS f{h}' for h in (1, 3, 6, 12))} FROM feat JOIN tq ON s = symbol WINDOW w AS (PARTITION BY symbol ORDER BY time_utc)),
sg AS (SELECT symbol, time_utc, unnest([1, 3, 6, 12]) AS horizon, unnest([f1, f3, f6, f12]) AS v FROM fw WHERE gate),
sr AS (SELECT symbol, horizon, v, row_number() OVER (PARTITION BY symbol, horizon ORDER BY time_utc) - 1 AS pos, count(*) OVER (PARTITION BY symbol, horizon) AS n FROM sg WHERE v IS NOT NULL),
sl AS (SELECT symbol, horizon, n, rep, unnest(generate_series(0, n - 1)) AS i FROM (SELECT DISTINCT symbol, horizon, n FROM sr), (SELECT unnest(range(500)) AS rep)),
mn AS (SELECT x.symbol, x.horizon, rep, avg(v) AS m FROM (SELECT *, ('0x' || left(md5('42:' || rep || ':' || i), 13))::BIGINT % n AS src FROM sl) x JOIN sr ON sr.symbol = x.symbol AND sr.horizon = x.horizon AND sr.pos = x.src GROUP BY ALL),
iv AS (SELECT symbol, horizon, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM mn GROUP BY ALL),
ed AS (SELECT symbol, horizon, count(*) AS n, avg(v) AS mean_ret FROM sr GROUP BY ALL),
bh AS (SELECT symbol, horizon AS best_horizon, round(mean_ret, 12) AS best_mean FROM ed QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(mean_ret, 12) DESC, horizon) = 1)"""  # fmt: skip


@query("T20_screening", SCREENED, sql="SELECT symbol, CAST(horizon AS INT) AS horizon, CAST(n AS BIGINT) AS n, round(mean_ret, 12) AS mean_ret, round(low, 12) AS low, round(high, 12) AS high, CAST(best_horizon AS INT) AS best_horizon, best_mean, low > 0 AS significant FROM ed JOIN iv USING (symbol, horizon) JOIN bh USING (symbol)")
def t20(spark, folder):
    """Features, gate, signals, forward returns, edge with interval and best horizon, for all symbols at once."""
    from barloom.operators.gates import trend_gate
    from barloom.operators.resample import bootstrap_mean
    from barloom.plans.feature_queries import features

    rows = W.forward_returns(trend_gate(features(spark, folder)), (1, 3, 6, 12)).where("gate_long")
    long = rows.select("symbol", "time_utc", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("ret")) for h in (1, 3, 6, 12)])).alias("p")).select("symbol", "time_utc", "p.horizon", "p.ret").where("ret is not null")
    edge = long.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))
    interval = bootstrap_mean(long, ["symbol", "horizon"], ["time_utc"], "ret", 500, 42)
    best = M.best_horizon(edge, ["symbol"])
    out = edge.join(interval.select("symbol", "horizon", "low", "high").hint("shuffle_merge"), ["symbol", "horizon"]).join(best.hint("shuffle_merge"), "symbol").withColumn("significant", F.col("low") > 0)
    return out.withColumns({c: F.round(c, 12) for c in ("mean_ret", "low", "high")})


@query("F11_position_size", SQL_TRADES, sql="SELECT k1, k2, k3, k4, k5, greatest(0.25, least(3.0, 1.0 * 0.01 / (abs(gross_pnl) + 0.002))) AS size, (10000 * 0.01) / ((abs(gross_pnl) + 0.002) * 100 * 1.0) AS lots FROM trades")
def f11(spark, folder):
    stop = F.abs("gross_pnl") + 0.002
    return X.trades(spark, folder).select("k1", "k2", "k3", "k4", "k5", C.position_size(F.lit(1.0), F.lit(0.01), stop, 0.25, 3.0).alias("size"), C.lots(F.lit(10000.0), F.lit(0.01), stop * 100, F.lit(1.0)).alias("lots"))


RULES = {"daily_loss": 1250.5, "total_loss": 2500.5, "target": 1250.25, "min_days": 2}


def _replay_sql(keys: str, source: str, pnl: str) -> str:
    """keys ends in a comma if there are any."""
    names = keys.rstrip(", ")
    part = f"PARTITION BY {names} " if names else ""
    group = f"GROUP BY {names}" if names else ""
    return f"""r1 AS (SELECT {keys} {ORDER}, CAST(entry_time AS DATE) AS d, {pnl} AS pnl FROM {source}),
r2 AS (SELECT *, round(sum(pnl) OVER w, 6) AS ind, row_number() OVER w = 1 AS f FROM r1 WINDOW w AS (PARTITION BY {keys} d ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r3 AS (SELECT *, coalesce(min(ind) OVER (PARTITION BY {keys} d ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > -{RULES['daily_loss']}, true) AS o FROM r2),
r4 AS (SELECT *, round(sum(CASE WHEN o THEN pnl ELSE 0 END) OVER w, 6) AS eq, sum(CAST(f AS INT)) OVER w AS days FROM r3 WINDOW w AS ({part}ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r5 AS (SELECT *, CASE WHEN o AND eq <= -{RULES['total_loss']} THEN 1 WHEN o AND eq >= {RULES['target']} AND days >= {RULES['min_days']} THEN 2 ELSE 0 END AS st FROM r4),
r6 AS (SELECT *, coalesce(max(st) OVER ({part}ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r5),
r7 AS (SELECT {keys} count(*) FILTER (o) AS taken, count(*) FILTER (NOT o) AS skipped, count(*) FILTER (o AND pnl > 0) AS wins, coalesce(sum(pnl) FILTER (o), 0) AS final_pnl, least(0, min(eq)) AS max_loss, max(days) AS trading_days, coalesce(max(st) FILTER (st = 1), 0) = 1 AS violated_total, coalesce(max(st) FILTER (st = 2), 0) = 2 AS target_reached FROM r6 WHERE before = 0 {group}),
r8 AS (SELECT {keys} least(0, min(x)) AS worst_day FROM (SELECT {keys} d, round(sum(pnl), 6) AS x FROM r6 WHERE before = 0 AND o GROUP BY {keys} d) {group})"""


REPLAY_COLUMNS = "CAST(taken AS BIGINT) AS taken, CAST(skipped AS BIGINT) AS skipped, CAST(wins AS BIGINT) AS wins, round(final_pnl, 4) AS final_pnl, round(worst_day, 4) AS worst_day, round(max_loss, 4) AS max_loss, CAST(trading_days AS BIGINT) AS trading_days, worst_day <= -1250.5 AS violated_daily, violated_total, target_reached, CAST(25 * (CAST(trading_days >= 2 AS INT) + CAST(worst_day > -1250.5 AS INT) + CAST(max_loss > -2500.5 AS INT) + CAST(target_reached AS INT)) AS INT) AS discipline"


def by_entry_day(spark, folder, keys: list[str]) -> DataFrame:
    """Trades that lie by keys and day of entry."""
    return dealt(X.trades(spark, folder).withColumn("entry_day", F.to_date("entry_time")), [*keys, "entry_day"])


def _replayed(rows: DataFrame, keys: list[str], pnl, case: str | None = None) -> DataFrame:
    out = K.replay(rows, keys, TRADE_ORDER, F.col("entry_day"), pnl, RULES["daily_loss"], RULES["total_loss"], RULES["target"], RULES["min_days"], case)
    return out.select(*keys, *([case] if case else []), "taken", "skipped", "wins", F.round("final_pnl", 4).alias("final_pnl"), F.round("worst_day", 4).alias("worst_day"), F.round("max_loss", 4).alias("max_loss"), F.col("trading_days").cast("long").alias("trading_days"), "violated_daily", "violated_total", "target_reached", F.col("discipline").cast("int").alias("discipline"))


@query("T10_account_replay", SQL_TRADES, _replay_sql("symbol, side, ", "trades", "net_pnl_base * 20000"), sql=f"SELECT symbol, side, {REPLAY_COLUMNS} FROM r7 JOIN r8 USING (symbol, side)")
def t10(spark, folder):
    return _replayed(by_entry_day(spark, folder, ["symbol", "side"]), ["symbol", "side"], F.col("net_pnl_base") * 20000)


RISKS = "risky AS (SELECT trades.*, CAST(risk AS INT) AS risk FROM trades, (SELECT unnest([25, 50, 100, 200, 300]) AS risk))"


@query("T11_risk_sweep", SQL_TRADES, RISKS, _replay_sql("fold_id, risk, ", "risky", "net_pnl_base * 150 * risk"), sql=f"SELECT fold_id, risk, {REPLAY_COLUMNS} FROM r7 JOIN r8 USING (fold_id, risk)")
def t11(spark, folder):
    return _replayed(by_entry_day(spark, folder, ["fold_id"]), ["fold_id"], {r: F.col("net_pnl_base") * 150 * F.lit(r) for r in (25, 50, 100, 200, 300)}, "risk")


@query("T12_daily_overlay", SQL_TRADES, sql=f"SELECT symbol, CAST(count(*) AS BIGINT) AS n, round(sum(net_pnl_base), 4) AS total FROM (SELECT *, max(CAST(k >= 8 OR c <= -0.021 OR c >= 0.021 AS INT)) OVER (PARTITION BY symbol, d ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM (SELECT *, count(*) OVER w AS k, round(coalesce(sum(net_pnl_base) OVER w, 0), 9) AS c FROM (SELECT *, CAST(entry_time AS DATE) AS d FROM trades) WINDOW w AS (PARTITION BY symbol, d ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE st = 0 GROUP BY symbol")
def t12(spark, folder):
    rows = K.daily_overlay(X.trades(spark, folder), ["symbol"], TRADE_ORDER, F.to_date("entry_time"), F.col("net_pnl_base"), 8, -0.021, 0.021)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net_pnl_base"), 4).alias("total"))


@query("T13_position_notional", SQL_TRADES, sql="SELECT symbol, fold_id, round(l, 9) AS sl_loss, round(100 / greatest(1e-8, l), 4) AS notional, l <= 0.05 AS sane FROM (SELECT symbol, fold_id, coalesce(median(-net_pnl_base) FILTER (exit_reason = 'SL' AND net_pnl_base < 0), median(-net_pnl_base) FILTER (net_pnl_base < 0), 0.003) AS l FROM trades GROUP BY ALL)")
def t13(spark, folder):
    return K.notional(X.trades(spark, folder), ["symbol", "fold_id"], 100.0).select("symbol", "fold_id", F.round("sl_loss", 9).alias("sl_loss"), F.round("notional", 4).alias("notional"), "sane")


@query("S14_report_bundle", SQL_TRADES, sql="SELECT symbol, CAST(count(*) AS BIGINT) AS n_trades, CAST(count(*) AS BIGINT) AS n_snapshot, CAST(count(*) AS BIGINT) AS n_stored FROM trades GROUP BY symbol")
def s14(spark, folder):
    """Trades, one row of metrics and a snapshot written and read back."""
    rows, place = X.trades(spark, folder), scratch_folder(spark, "report")
    rows.write.parquet(f"{place}/trades")
    M.trade_metrics(rows, ["symbol"], "net_pnl_base").write.parquet(f"{place}/kpis")
    from barloom.sources.bars import snapshot_json

    snapshot_json(M.trade_metrics(rows, ["symbol"], "net_pnl_base")).write.text(f"{place}/snapshot")
    kpis, text = spark.read.parquet(f"{place}/kpis"), spark.read.text(f"{place}/snapshot")
    snap = text.select(F.from_json("value", "symbol string, n_trades long").alias("j")).select("j.*").withColumnRenamed("n_trades", "n_snapshot")
    stored = spark.read.parquet(f"{place}/trades").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_stored"))
    return kpis.select("symbol", "n_trades").join(snap, "symbol").join(stored, "symbol")


@query("S15_statistics_pack", SQL_TRADES, sql="SELECT 'trades' AS \"table\", CAST(count(*) AS BIGINT) AS n FROM trades UNION ALL SELECT 'core_metrics', count(DISTINCT (symbol, side)) FROM trades UNION ALL SELECT 'folds', count(DISTINCT fold_id) FROM trades UNION ALL SELECT 'costs', 3")
def s15(spark, folder):
    """Result tables as CSV, one folder each; how many rows each holds when read back."""
    rows, place = X.trades(spark, folder), scratch_folder(spark, "pack")
    tables = {
        "trades": rows.select("symbol", "fold_id", "segment", "side", "gross_pnl", "net_pnl_base"), "core_metrics": M.trade_metrics(rows, ["symbol", "side"], "net_pnl_base"),
        "folds": M.fold_metrics(rows, "net_pnl_base"), "costs": M.cost_sensitivity(rows, (1.0, 2.0, 4.0), 0.0004, 1000.0, 25000.0),
    }
    out = None
    for name, frame in tables.items():
        frame.write.csv(f"{place}/{name}", header=True)
        one = spark.read.csv(f"{place}/{name}", header=True).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("P14_date_windows", SQL_BARS, sql=f"SELECT symbol, CAST(count(*) FILTER (d > l - 7 AND d < l) AS BIGINT) AS last_week, CAST(count(*) FILTER (d <= DATE '2024-01-15') AS BIGINT) AS in_sample FROM (SELECT symbol, CAST(time_utc AS DATE) AS d, max(CAST(time_utc AS DATE)) OVER () AS l FROM bars) GROUP BY symbol")
def p14(spark, folder):
    bars = X.bars(spark, folder).withColumn("d", F.to_date("time_utc"))
    last = bars.agg(F.max("d").alias("l"))
    rows = bars.join(F.broadcast(last))
    return rows.groupBy("symbol").agg(F.count_if((F.col("d") > F.date_sub("l", 7)) & (F.col("d") < F.col("l"))).alias("last_week"), F.count_if(F.col("d") <= F.to_date(F.lit("2024-01-15"))).alias("in_sample"))


PAIRS = SQL_BARS + f""",
dc AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret FROM (SELECT symbol, {DAY} AS d, last(close ORDER BY time_utc) AS close FROM bars WHERE volume >= 2 OR symbol <> 'VIEW' GROUP BY ALL)),
dr AS (SELECT * FROM dc WHERE ret IS NOT NULL),
cd AS (SELECT * FROM dr WHERE d IN (SELECT d FROM dr GROUP BY d HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM dr))),
rho AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS rho, count(*) AS days FROM cd x JOIN cd y ON x.d = y.d AND x.symbol < y.symbol GROUP BY ALL)"""  # fmt: skip


def common(spark, folder) -> DataFrame:
    return M.common_days(daily_close(X.bars(spark, folder).where("volume >= 2 or symbol <> 'VIEW'")).where("ret is not null"))


@query("J2_common_days", PAIRS, sql="SELECT symbol, d, round(ret, 9) AS ret FROM cd")
def j2(spark, folder):
    return common(spark, folder).select("symbol", day().alias("d"), F.round("ret", 9).alias("ret"))


@query("A38_correlations", PAIRS, sql="SELECT a, b, round(rho, 9) AS rho, CAST(days AS BIGINT) AS days FROM rho")
def a38(spark, folder):
    return M.correlations(common(spark, folder)).select("a", "b", F.round("rho", 9).alias("rho"), "days")


@query("A39_joint_losses", PAIRS, sql="WITH d AS (SELECT d, count(*) FILTER (ret < 0) AS l, sum(ret) AS s FROM cd GROUP BY d) SELECT CAST(k AS INT) AS k, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM d), 6) AS share_pct, round((SELECT min(s) FROM d), 9) AS worst, round((SELECT max(s) FROM d), 9) AS best FROM d, (SELECT unnest(generate_series(1, 5)) AS k) WHERE l >= k GROUP BY k")
def a39(spark, folder):
    return M.joint_losses(common(spark, folder))


@query("A40_position_limit", PAIRS, sql="SELECT round(avg(rho), 9) AS avg_rho, round(max(rho), 9) AS max_rho, round(min(rho), 9) AS min_rho, round(coalesce(avg(rho) FILTER (a IN ('CLICK', 'ERROR', 'VIEW') AND b IN ('CLICK', 'ERROR', 'VIEW')), 0), 9) AS group_rho, CAST(CASE WHEN max(rho) >= 0.60 THEN 1 WHEN avg(rho) >= 0.20 THEN 2 ELSE 3 END AS INT) AS max_positions FROM rho")
def a40(spark, folder):
    out = M.position_limit(M.correlations(common(spark, folder)), ("CLICK", "ERROR", "VIEW"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("avg_rho", "max_rho", "min_rho", "group_rho")], "max_positions")

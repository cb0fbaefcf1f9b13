"""Instrument classes and trading costs as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and names by which instruments are told apart.
INDEX_PATTERN = r"(US500|US100|US30|GER40|FRA40|UK100|EU50|JP225|\.CASH)"
METAL_PATTERN = r"^(XAU|XAG|XPT|XPD)"
ENERGY_PATTERN = r"(WTI|BRENT|UKOIL|USOIL|NGAS|NATGAS)"
EQUITY_PATTERN = "STOCK|SHARE|EQUITY"
MAJORS = ("USD", "EUR", "JPY", "GBP", "AUD", "NZD", "CAD", "CHF")
CRYPTO_PREFIXES = (
    "BTC", "ETH", "SOL", "BNB", "ADA", "XRP", "DOGE", "LTC", "DOT", "AVAX", "UNI", "LINK", "XLM", "ATOM", "ETC", "FIL", "AAVE", "ALGO", "NEAR", "SUI", "ARB", "OP", "APT", "MATIC", "TON", "PEPE", "SHIB",
)
CRYPTO_NAMES = ("BTC", "ETH", "LTC", "XRP", "BNB", "SOL", "DOGE", "ADA", "DOT", "AVAX", "LINK", "UNI")
MORE_CRYPTO_NAMES = (*CRYPTO_NAMES, "ICP", "DASH", "EOS", "NEAR", "APE", "SHIB")
METAL_NAMES = ("XAU", "XAG", "XPT", "XPD")
ENERGY_NAMES = ("WTI", "BRENT", "OIL", "UKOIL", "USOIL", "XTIUSD", "XBRUSD", "NGAS")
INDEX_NAMES = ("US500", "US100", "US30", "SPX", "NAS", "NDX", "DAX", "FTSE", "NI225", "JP225", "GER", "UK100", "FRA40", "AUS200", "HK50", "STOXX")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "AUD", "NZD", "CAD", "CHF", "SEK", "NOK", "DKK", "SGD", "HKD", "MXN", "ZAR", "TRY", "PLN", "HUF", "CZK", "CNH", "CNY")


def asset_class(symbol: Column, path: Column, description: Column) -> Column:
    """Class from symbol, path and description."""
    s, p, d = (F.coalesce(F.upper(x), F.lit("")) for x in (symbol, path, description))
    fx = F.length(s).between(6, 10) & F.right(s, F.lit(3)).isin(*MAJORS)
    return (
        F.when(s.rlike(INDEX_PATTERN) | p.rlike(INDEX_PATTERN), "INDEX")
        .when(s.rlike(METAL_PATTERN), "METAL")
        .when(s.rlike(ENERGY_PATTERN) | p.rlike(ENERGY_PATTERN), "ENERGY")
        .when(F.contains(p, F.lit("CRYPTO")) | F.contains(d, F.lit("CRYPTO")) | s.rlike(f"^({'|'.join(CRYPTO_PREFIXES)})"), "CRYPTO")
        .when(fx & F.left(s, F.lit(3)).isin(*MAJORS), "FX_MAJOR")
        .when(fx, "FX_MINOR")
        .when(p.rlike(EQUITY_PATTERN) | d.rlike(EQUITY_PATTERN), "EQUITY")
        .otherwise("OTHER")
    )


def asset_class_by_name(symbol: Column, crypto: Sequence[str] = CRYPTO_NAMES) -> Column:
    s = F.upper(symbol)
    return (
        F.when(s.rlike("|".join(crypto)), "crypto")
        .when(s.rlike("|".join(METAL_NAMES)), "metal")
        .when(s.rlike("|".join(ENERGY_NAMES)), "energy")
        .when(s.rlike("|".join(INDEX_NAMES)), "index")
        .when(s.rlike(f"^({'|'.join(CURRENCIES)})|({'|'.join(CURRENCIES)})$"), "forex")
        .otherwise("other")
    )


def commission(quotes: DataFrame, overrides: DataFrame, classes: DataFrame, default: float) -> DataFrame:
    """commission_usd: of the symbol, else of its class, else the default; twice where it is not for the round trip.

    overrides (symbol, value_usd, round_trip) and classes (asset_class, value_usd, round_trip) are price lists of a few rows.
    """
    whole = lambda t: F.when(F.coalesce(F.col(f"{t}.round_trip"), F.lit(True)), F.col(f"{t}.value_usd")).otherwise(2 * F.col(f"{t}.value_usd"))
    rows = quotes.alias("q").join(overrides.alias("o"), F.col("q.symbol") == F.col("o.symbol"), "left").join(F.broadcast(classes.alias("c")), F.col("q.asset_class") == F.col("c.asset_class"), "left")
    return rows.select("q.*", F.coalesce(whole("o"), whole("c"), F.lit(float(default))).alias("commission_usd"))


def quote_costs(quotes: DataFrame, slippage_bps: float) -> DataFrame:
    """mid, spread_bps, commission_bps, slippage_bps and cost_bps; null without a valid tick."""
    valid = F.coalesce((F.col("bid") > 0) & (F.col("ask") > 0), F.lit(False))
    rows = quotes.withColumns({"valid_tick": valid, "mid": F.when(valid, (F.col("bid") + F.col("ask")) * 0.5)})
    priced = F.when(F.col("contract_size") > 0, F.try_divide(F.col("commission_usd"), F.col("mid") * F.col("contract_size")) * 10000)
    rows = rows.withColumns({
        "spread_bps": F.when(F.col("valid_tick") & (F.col("ask") > F.col("bid")), (F.col("ask") - F.col("bid")) / F.col("mid") * 10000),
        "commission_bps": F.coalesce(priced, F.when(F.col("commission_usd") == 0, 0.0)), "slippage_bps": F.lit(float(slippage_bps)),
    })
    total = F.coalesce("spread_bps", F.lit(0.0)) + F.coalesce("commission_bps", F.lit(0.0)) + F.col("slippage_bps")
    return rows.withColumn("cost_bps", F.when(F.col("valid_tick"), total))


def eligibility(quotes: DataFrame) -> DataFrame:
    """eligible, reason and cost_flag from cost_bps and threshold_bps."""
    over = F.coalesce(F.col("cost_bps") > F.col("threshold_bps"), F.lit(False))
    within = F.coalesce(F.col("cost_bps") <= F.col("threshold_bps"), F.lit(False))
    seen, mode = F.coalesce("visible", F.lit(True)), F.coalesce(F.col("trade_mode") >= 0, F.lit(True))
    flags = F.array(
        F.when(~F.col("valid_tick"), "NO_TICK").otherwise(""), F.when(F.col("spread_bps").isNull(), "SPREAD_BPS_MISSING").otherwise(""), F.when(F.col("commission_bps").isNull(), "COMMISSION_BPS_MISSING").otherwise(""),
        F.when(over, F.concat(F.lit("COST>"), F.round("threshold_bps", 2).cast("string"), F.lit("bps"))).otherwise(""), F.when(~seen, "NOT_VISIBLE").otherwise(""), F.when(~mode, "TRADE_MODE<0").otherwise(""),
    )
    return quotes.withColumns({
        "eligible": F.col("valid_tick") & within & seen & mode, "reason": F.array_join(F.filter(flags, lambda x: x != ""), ";"), "cost_flag": cost_flag(F.col("cost_bps"), F.col("threshold_bps")),
    })


def cost_flag(cost: Column, threshold: Column) -> Column:
    return F.when(cost.isNull() | threshold.isNull(), "UNKNOWN").when(cost <= threshold * 0.5, "OK").when(cost <= threshold, "CARO").otherwise("PROHIBITIVO")


def spread_in_bps(spread: Column, close: Column) -> Column:
    return F.try_divide(spread, close) * 10000


def round_trip(spread_bps: Column, commission_bps: Column, slippage_bps: Column) -> Column:
    """Cost of a round trip as a fraction."""
    return 2 * (spread_bps / 2 + commission_bps + slippage_bps) / 10000


def stressed(spread_bps: Column, commission_bps: Column, slippage_bps: Column, cost_factor: float = 2.0, slippage_factor: float = 3.0) -> Column:
    return round_trip(spread_bps * cost_factor, commission_bps * cost_factor, slippage_bps * slippage_factor)


def fill_price(open_price: Column, side: Column, spread_bps: Column, slippage_bps: Column) -> Column:
    """The price at the open, worse by half the spread and the slippage. side: +1 buys, -1 sells."""
    return open_price * (1 + side * (slippage_bps + spread_bps / 2) / 10000)


def position_size(equity: Column, risk: Column, stop: Column, least: float, most: float) -> Column:
    """Risk over stop distance, between bounds; 0 without a stop."""
    return F.when(stop > 0, F.greatest(F.lit(least), F.least(F.lit(most), F.try_divide(equity * risk, stop)))).otherwise(0.0)


def lots(account: Column, risk: Column, stop: Column, contract_size: Column) -> Column:
    return F.when((stop > 0) & (contract_size > 0) & (account > 0), F.try_divide(account * risk, stop * contract_size)).otherwise(0.0)


GAP_BPS: Mapping[str, tuple[float, float]] = {"equity": (2.0, 6.0), "fx_metal": (1.0, 3.0)}


def cost_model(stats: DataFrame) -> DataFrame:
    """Base and stress costs by symbol. stats: asset_class, base_cost_bps, stress_cost_bps, n_rows, n_spread, spread_med, spread_p95, vol_med, vol_p95."""
    usable = (F.col("n_spread") / F.greatest("n_rows", F.lit(1)) >= 0.10) & F.col("spread_med").isNotNull()
    floor = lambda c: F.greatest(c, F.lit(0.0))
    gap = lambda k: F.coalesce(*[F.when(F.col("asset_class") == name, v[k]) for name, v in GAP_BPS.items()], F.lit(0.0))
    rows = stats.withColumns({
        "slippage_method": F.when(usable, "spread").otherwise("volatility"),
        "slippage_base": F.when(usable, floor(F.col("spread_med")) * 0.50).otherwise(floor(F.coalesce("vol_med", F.lit(0.0))) * 0.10),
        "slippage_stress": F.when(usable, floor(F.coalesce("spread_p95", "spread_med")) * 0.75).otherwise(floor(F.coalesce("vol_p95", "vol_med", F.lit(0.0))) * 0.15),
        "gap_base": gap(0), "gap_stress": gap(1),
    })
    rows = rows.withColumns({"total_base": F.col("base_cost_bps") + F.col("slippage_base") + F.col("gap_base"), "total_stress": F.col("stress_cost_bps") + F.col("slippage_stress") + F.col("gap_stress")})
    return rows.withColumn("valid", (F.col("total_base") > 0) & (F.col("total_stress") > 0) & (F.col("total_stress") >= F.col("total_base")))


def micro_structure(bars: DataFrame) -> DataFrame:
    """Median and 95th percentile of spread and absolute return in bps, and how many spreads there are."""
    from barloom.functions.ranks import nearest_ranks
    from barloom.operators.features import returns

    rows = returns(bars).withColumns({"spread_bps": spread_in_bps(F.col("spread"), F.col("close")), "abs_ret_bps": F.abs("ret") * 10000})
    base = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count("spread_bps").alias("n_spread"), F.median("spread_bps").alias("spread_med"), F.median("abs_ret_bps").alias("vol_med"))
    ranks = nearest_ranks(rows, ["symbol"], {"spread_bps": {"spread_p95": 0.95}, "abs_ret_bps": {"vol_p95": 0.95}})
    return base.join(ranks.hint("shuffle_merge"), "symbol", "left")


def typical_commission(quotes: DataFrame, defaults: Mapping[str, float], global_default: float = 0.5) -> DataFrame:
    """commission_eff_bps: own if positive, else the class's median of positive ones, else the class's default, else the global one."""
    typical = quotes.where("commission_bps > 0").groupBy("asset_class").agg(F.median("commission_bps").alias("typical"))
    default = F.coalesce(*[F.when(F.col("asset_class") == k, float(v)) for k, v in defaults.items()], F.lit(global_default))
    rows = quotes.join(F.broadcast(typical.where("asset_class is not null")), "asset_class", "left")
    return rows.withColumn("commission_eff_bps", F.when(F.col("commission_bps") > 0, F.col("commission_bps")).otherwise(F.coalesce("typical", default)))


def recost(trades: DataFrame, costs: DataFrame, base: str = "base_bps", stress: str = "stress_bps", default: tuple[float, float] = (8.0, 16.0)) -> DataFrame:
    """Net results under each symbol's costs; cost_known tells where the default was used."""
    rows = trades.join(costs.select("symbol", F.col(base).alias("_b"), F.col(stress).alias("_s")), "symbol", "left")
    rows = rows.withColumn("cost_known", F.col("_b").isNotNull())
    net = lambda c, d: F.col("gross_pnl") - F.coalesce(F.col(c), F.lit(d)) / 10000
    return rows.withColumns({"net_base": net("_b", default[0]), "net_stress": net("_s", default[1])}).drop("_b", "_s")

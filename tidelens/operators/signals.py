"""Signals, market conditions and strategy parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, div
from ..functions.rolling import pct, std
from . import registry
from .rules import lookup
from .series import blocks, number_rows, prefix, unblock


def confidence(kind: str, prediction: str, uncertainty: Column | None = None, top: Column | None = None) -> Column:
    """Confidence by signal type, lowered by uncertainty over its maximum (``top``)."""
    p = F.col(prediction)
    base = {
        "binary": lambda: F.abs(p - 0.5) * 2.0,
        "probability": lambda: p,
        "multi_class": lambda: F.element_at(F.sort_array(p, False), 1) - F.element_at(F.sort_array(p, False), 2),
        "regression": lambda: F.lit(0.8) if uncertainty is None else F.lit(1.0),
    }.get(kind, lambda: F.lit(0.5))()
    if uncertainty is not None:
        base = base * (1.0 - clip(F.coalesce(div(uncertainty, top), F.lit(0.0)), 0.0, 1.0))
    return clip(base, 0.0, 1.0)


def signal(kind: str, prediction: str, sure: Column, least: float = 0.6, buy: float | None = None, sell: float | None = None) -> Column:
    """-1, 0 or 1; 0 under the confidence threshold."""
    p = F.col(prediction)
    if kind == "multi_class":
        best = F.array_position(p, F.array_max(p)) - 1
        raw = F.when(best == 0, -1).when(best == 2, 1).otherwise(0)
    else:
        # default thresholds by type (fixed values)
        up, down = {"binary": (0.5, 0.5), "probability": (0.7, 0.3), "regression": (0.02, -0.01)}[kind]
        raw = F.when(p > (up if buy is None else buy), 1).when(p < (down if sell is None else sell), -1).otherwise(0)
    return F.when(sure < least, 0).otherwise(raw)


def postprocess(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Needs close, direction (probability), magnitude, volatility."""
    p, close, mag = F.col("direction"), F.col("close"), F.col("magnitude")
    sig = F.when(p > threshold, "buy").when(p < 1 - threshold, "sell").otherwise("neutral")
    conf = F.when(p > threshold, p).when(p < 1 - threshold, 1.0 - p).otherwise(0.5 - F.abs(0.5 - p))
    rec = (F.when((sig == "buy") & (conf > 0.7), "strong_buy").when(sig == "buy", "buy").when((sig == "sell") & (conf > 0.7), "strong_sell")
           .when(sig == "sell", "sell").otherwise("hold"))
    up = F.when(p > 0.5, 1.0).otherwise(-1.0)
    return rows.withColumns({
        "signal": sig, "confidence": conf, "expected_direction": F.when(p > 0.5, "up").otherwise("down"), "expected_change": close * mag,
        "target_price": close * (1.0 + up * F.abs(mag)), "range_upper": close * (1.0 + mag + F.col("volatility")),
        "range_lower": close * (1.0 + mag - F.col("volatility")), "recommendation": rec})


def ensemble(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, model, prediction, weight): weighted mean, mean, deviation, and the lower median.

    A group is one row's set of models, so it is small by construction.
    """
    n = F.count(F.lit(1))
    ordered = F.sort_array(F.collect_list("prediction"))
    g = rows.groupBy(*keys).agg(
        div(F.sum(F.col("prediction") * F.col("weight")), F.sum("weight")).alias("weighted"), F.avg("prediction").alias("mean"),
        F.stddev_pop("prediction").alias("std"), F.element_at(ordered, F.floor((n + 1) / 2).cast("int")).alias("median"))
    return g


def market_conditions(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Trend, volatility, momentum and regime of every bar, on raw indicator values."""
    x = registry.many(bars, {
        "sma_50": ("sma", 50), "sma_200": ("sma", 200), "atr": ("atr", 14), "bb": ("bollinger", 20), "rsi": ("rsi", 14), "m": ("macd", 12),
    }, rows, keep=("symbol", "ts", "close"))
    c = F.col("close")

    def side(ma):
        return F.when(c > F.col(ma), "bullish").when(c < F.col(ma), "bearish").when(c == F.col(ma), "neutral")

    x = x.withColumns({"s50": side("sma_50"), "s200": side("sma_200"), "atr_pct": 100.0 * div("atr", "close"),
                       "band": div(F.col("bb_upper") - F.col("bb_lower"), "bb_middle")})
    trend = (F.when((F.col("s50") == "bullish") & (F.col("s200") == "bullish"), "bullish").when((F.col("s50") == "bearish") & (F.col("s200") == "bearish"), "bearish")
             .when((F.col("s50") == "bullish") & (F.col("s200") == "bearish"), "cautiously_bullish")
             .when((F.col("s50") == "bearish") & (F.col("s200") == "bullish"), "cautiously_bearish").otherwise("neutral"))
    state = F.when(F.col("rsi") > 70, "overbought").when(F.col("rsi") < 30, "oversold").when(F.col("rsi").isNotNull(), "neutral")
    rising = F.col("m_macd") > 0
    momentum = (F.when((state == "overbought") & rising, "strongly_bullish").when((state == "oversold") & ~rising, "strongly_bearish")
                .when((state == "neutral") & rising, "bullish").when((state == "neutral") & ~rising, "bearish")
                .when(state == "overbought", "overbought").when(state == "oversold", "oversold").otherwise("neutral"))
    level = F.when(F.col("atr_pct") > 3, "high").when(F.col("atr_pct") > 1, "medium").when(F.col("atr_pct").isNotNull(), "low").otherwise("normal")
    suffix = F.when(F.col("band") < 0.03, "_contracting").when(F.col("band") > 0.1, "_expanding").otherwise("")
    x = x.withColumns({"trend": trend, "momentum": momentum, "volatility": F.concat(level, suffix)})
    regime = (F.when((F.col("trend") == "bullish") & (F.col("volatility") != "high"), "uptrend").when((F.col("trend") == "bearish") & (F.col("volatility") != "high"), "downtrend")
              .when(F.col("volatility") == "high", "volatile").when(F.col("volatility").endswith("contracting"), "consolidation").otherwise("range_bound"))
    return x.select("symbol", "ts", "close", "trend", "momentum", "volatility", regime.alias("regime"), "rsi", "atr_pct", "band")


# Rules by market regime and by risk profile.
REGIME_RULES = {
    "uptrend": ("moderate", "long", True, "sma_20,sma_50,macd"),
    "downtrend": ("conservative", "short", True, "sma_20,sma_50,macd"),
    "volatile": ("very_conservative", "both", True, "bollinger_bands,atr,volatility_ratio"),
    "consolidation": ("conservative", "both", False, "bollinger_bands,keltner_channel,donchian_channel"),
    "range_bound": ("moderate", "both", False, "support_resistance,pivot_points,rsi"),
}
PROFILE_RULES = {  # largest position, stop loss, reward to risk, risk per trade, base position
    "very_conservative": (0.05, 0.02, 1.5, 0.005, 0.03),
    "conservative": (0.10, 0.03, 2.0, 0.01, 0.05),
    "moderate": (0.15, 0.05, 2.5, 0.02, 0.10),
    "aggressive": (0.25, 0.08, 3.0, 0.03, 0.15),
}


def strategy_parameters(conditions: DataFrame) -> DataFrame:
    """Risk profile, sizes, stops and indicators for each bar's regime."""
    def by_regime(i):
        return lookup({k: v[i] for k, v in REGIME_RULES.items()}, F.col("regime"))

    def by_profile(i):
        return lookup({k: v[i] for k, v in PROFILE_RULES.items()}, F.col("profile"))

    scale = F.when(F.col("volatility").startswith("high"), 1.5).when(F.col("volatility").startswith("low"), 0.8).otherwise(1.0)
    x = conditions.withColumns({"profile": by_regime(0), "direction": by_regime(1), "trailing_stop": by_regime(2), "indicators": by_regime(3)})
    x = x.withColumns({"max_position": by_profile(0), "stop_loss": by_profile(1) * scale, "risk_per_trade": by_profile(3), "base_position": by_profile(4)})
    return x.withColumn("take_profit", F.col("stop_loss") * by_profile(2))


def daily_trades(trades: DataFrame) -> DataFrame:
    """Profit by date with its running total."""
    d = trades.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("trades"))
    return prefix(number_rows(d, ("symbol",), ("day",), F.date_trunc("year", "day")), {"running": ("sum", F.col("profit"))}).drop("_rn")


def states_from_wide(wide: DataFrame, suffixes=("price", "volume", "liquidity", "volatility")) -> DataFrame:
    """``{asset}_{suffix}`` columns to one row per (ts, asset)."""
    found: dict[str, dict[str, str]] = {}
    for n in wide.columns:
        asset, _, kind = n.rpartition("_")
        if kind in suffixes and asset:
            found.setdefault(asset, {})[kind] = n
    kinds = [k for k in suffixes if any(k in v for v in found.values())]
    cells = [F.struct(F.lit(a).alias("asset"), *[(F.col(v[k]).cast("double") if k in v else F.lit(None).cast("double")).alias(k) for k in kinds]) for a, v in found.items()]
    return wide.select("ts", F.inline(F.array(*cells)))


def state_volatility(states: DataFrame, n: int = 24) -> DataFrame:
    """Rolling deviation of returns per asset."""
    x = number_rows(states.withColumnRenamed("asset", "symbol"))
    x = blocks(x, n + 1).withColumn("_r", pct("price")).withColumn("volatility", std("_r", n))
    return unblock(x).withColumnRenamed("symbol", "asset").drop("_r", "_rn")


def window_batches(conditions: DataFrame, window: int, step: int) -> DataFrame:
    """The condition row at the end of each window of ``window`` bars, every ``step`` bars."""
    x = number_rows(conditions)
    return x.filter((F.col("_rn") >= window) & ((F.col("_rn") - window) % step == 0)).drop("_rn")

"""The indicator registry: names, default periods, and one call that computes many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import indicators as I
from ..session import cut_lineage
from .series import prefix
from .stages import Indicator, Temp, compute

# Registry names of the bar-indicator family (fixed values).
REGISTRY: dict[str, Indicator] = {
    name: getattr(I, name)
    for name in (
        "sma ema wma dema tema trima kama macd ppo adx rsi stoch stochrsi williams cci mfi tsi ultimate "
        "atr bollinger keltner donchian vortex obv vwap pvt cmf ad eom heikin_ashi parabolic_sar ichimoku "
        "supertrend engulfing hammer doji pivot_points zscore variance kurtosis skewness vpin kyle_lambda "
        "amihud correlation relative_performance beta price_momentum volatility_ratio trend_strength "
        "oscillator_divergence volume_pressure"
    ).split()
}

# The config-driven set: same bars, other definitions.
CONFIG_SET: dict[str, Indicator] = {
    name: getattr(I, name)
    for name in (
        "adx_smoothed psar ichimoku_cloud awesome_oscillator roc relative_return cci_running natr "
        "bollinger_shape keltner_typical price_channels historical_volatility obv_seeded vwap_daily "
        "volume_features spread_features price_volume_correlation rolling_stats moments_moving_mean "
        "kyle_ratio roll_spread range_volatility volume_weighted_volatility tick_rule efficiency_coefficient "
        "semi_volatility reversals volume_bucket_vpin support_resistance loader_returns rsi_wilder atr_wilder"
    ).split()
}

NEEDS_REFERENCE = {"correlation", "relative_performance", "beta"}

# Default periods by family (fixed values).
DEFAULT_PERIODS = {
    **dict.fromkeys("sma ema wma dema tema trima kama".split(), [14, 50, 200]),
    **dict.fromkeys("obv vwap pvt cmf ad eom zscore variance kurtosis skewness".split(), [20]),
    "macd": [12], "supertrend": [10], "ichimoku": [9], "parabolic_sar": [0.02],
}


def register(name: str, indicator: Indicator, periods: list | None = None) -> None:
    """Add a user indicator: a generator over ``stages`` requests."""
    REGISTRY[name] = indicator
    if periods:
        DEFAULT_PERIODS[name] = list(periods)


def default_periods(name: str) -> list:
    return DEFAULT_PERIODS.get(name, [14])


def _labels(selected, periods):
    for name in selected:
        if name in REGISTRY:
            chosen = (periods or {}).get(name, default_periods(name))
            for p in chosen:
                yield name, p, f"{name}_{p}" if len(chosen) > 1 else name


def indicator_frame(bars: DataFrame, name: str, period, label: str | None = None, rows=None, **options) -> DataFrame:
    """One indicator from either set over numbered bars."""
    fn = REGISTRY.get(name) or CONFIG_SET[name]
    label = label or name
    return compute(bars, {label: fn(Temp(label), period, **options)}, rows=rows)


def many(bars: DataFrame, wanted: dict[str, tuple], rows=None, keep=("symbol", "ts")) -> DataFrame:
    """label -> (registered name, period[, options]) in shared passes."""
    gens = {}
    for label, (name, period, *opt) in wanted.items():
        fn = REGISTRY.get(name) or CONFIG_SET[name]
        gens[label] = fn(Temp(label), period, **(opt[0] if opt else {}))
    return compute(bars, gens, keep=keep, rows=rows)


# Name prefixes of the dataset pack (fixed values).
PACK = {"rsi": "rsi", "sma": "sma", "ema": "ema", "macd": "macd", "bb": "bollinger", "atr": "atr"}


def by_names(bars: DataFrame, names: list[str], rows=None) -> DataFrame:
    """Indicators asked for as ``rsi_14``, ``bb_20``, ``macd``; unknown names are left out."""
    wanted = {}
    for name in names:
        kind, _, period = name.partition("_")
        if kind in PACK:
            wanted[name] = (PACK[kind], int(period) if period else default_periods(PACK[kind])[0])
    return many(bars, wanted, rows)


def calculate_all(bars: DataFrame, selected=None, periods=None, fill: bool = True, rows=None) -> DataFrame:
    """All (or selected) registered indicators; gaps carry the last value, then 0.

    Cross-asset indicators are skipped unless the bars have a ``ref`` column.
    """
    selected = list(selected or REGISTRY)
    if "ref" not in bars.columns:
        selected = [n for n in selected if n not in NEEDS_REFERENCE]
    gens = {label: REGISTRY[n](Temp(label), p) for n, p, label in _labels(selected, periods)}
    keep = ("symbol", "ts", "_rn", "open", "high", "low", "close", "volume")
    out = compute(bars, gens, keep=keep, rows=rows)
    if fill:
        out = cut_lineage(out)
        names = [n for n in out.columns if n not in keep]
        out = prefix(out, {f"_f_{n}": ("last", F.col(n)) for n in names})
        out = out.select(*keep, *[F.coalesce(F.col(f"_f_{n}"), F.lit(0)).alias(n) for n in names])
    return out.drop("_rn")


def feature_names(selected=None, periods=None) -> list[str]:
    """Output names without computing: the generators are only driven, no job runs."""
    names = []
    for n, p, label in _labels(list(selected or REGISTRY), periods):
        gen = REGISTRY[n](Temp(label), p)
        try:
            while True:
                next(gen)
        except StopIteration as stop:
            names += [f"{label}_{part}" if part else label for part in stop.value]
    return names

"""Feature columns over numbered series: side series, calendar, lags, differences.

All windowed features of a call are computed in one blocked pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import div, log_safe
from ..functions.rolling import diff, lag, mean, pct, quantile, roll2, std
from .series import WIDE_FRAME, blocks, unblock


def apply_steps(numbered: DataFrame, steps: list[dict[str, Column]], history: int, rows: int | None = None) -> DataFrame:
    x = blocks(numbered, history, rows=rows, spread=history >= WIDE_FRAME)
    for step in steps:
        x = x.withColumns(step)
    return unblock(x)


def _z(x: str, n: int) -> Column:
    return div(F.col(x) - mean(x, n), std(x, n))


def _pick(columns: list[str], *words: str) -> str | None:
    return next((c for c in columns if all(w in c.lower() for w in words)), None)


def on_chain(columns: list[str], price: str = "close") -> tuple[list[dict], int]:
    out = {}
    for c in columns:
        out.update({f"{c}_change_{k}d": pct(c, k) for k in (1, 7, 30)})
        out.update({f"{c}_zscore_{n}": _z(c, n) for n in (20, 50, 200)})
        out.update({f"{c}_price_corr_{n}": roll2(F.corr, price, c, n) for n in (30, 90)})
    second = {}
    if a := _pick(columns, "active_address"):
        out["active_addr_momentum"] = div(pct(a, 7), pct(a, 30))
    if a := _pick(columns, "transaction", "count"):
        out["tx_growth_rate"] = pct(a, 7)
        out.update({f"tx_count_sma_{n}": mean(a, n) for n in (7, 30)})
    if a := _pick(columns, "difficult"):
        out["difficulty_growth_rate"] = pct(a, 14)
    if a := _pick(columns, "fee"):
        out.update({f"fee_sma_{n}": mean(a, n) for n in (7, 30)})
        out["_fee_change"] = pct(a)
        second["fee_volatility"] = std("_fee_change", 30)
    if a := _pick(columns, "hash", "rate"):
        out["hash_rate_growth"] = pct(a, 30)
    inflow, outflow = _pick(columns, "exchange", "inflow"), _pick(columns, "exchange", "outflow")
    if inflow and outflow:
        out["exchange_net_flow"] = F.col(outflow) - F.col(inflow)
        out["exchange_flow_ratio"] = div(outflow, inflow)
    if a := _pick(columns, "utxo"):
        out["utxo_change"] = pct(a)
    if a := _pick(columns, "supply") or _pick(columns, "circulation"):
        out["supply_growth_rate"] = pct(a, 30) * 365.0
    return [out, second], 200


def sentiment(columns: list[str], price: str = "close") -> tuple[list[dict], int]:
    out, second = {}, {}
    for c in columns:
        out.update({f"{c}_sma_{n}": mean(c, n) for n in (3, 7, 14, 30)})
        out.update({f"{c}_change_{k}d": pct(c, k) for k in (1, 7, 14)})
        out.update({f"{c}_zscore_{n}": _z(c, n) for n in (30, 90)})
        out.update({f"{c}_price_corr_{n}": roll2(F.corr, price, c, n) for n in (14, 30, 60)})
        out[f"{c}_momentum"] = diff(c, 3) / 3.0
        out[f"{c}_volatility"] = std(c, 14)
        out[f"{c}_divergence"] = _z(price, 30) - _z(c, 30)
    if a := _pick(columns, "volume"):
        out["social_volume_price_ratio"] = div(a, price)
        out["social_volume_norm"] = div(a, mean(a, 30))
    if a := _pick(columns, "score"):
        z = F.col(f"{a}_zscore_90")
        second["sentiment_extreme"] = F.when(F.abs(z) > 2, F.signum(z)).otherwise(0.0)
        second["sentiment_trend"] = F.signum(F.col(f"{a}_sma_3") - F.col(f"{a}_sma_14"))
    if a := _pick(columns, "dominance"):
        out["dominance_change"] = pct(a, 7)
    return [out, second], 90


def global_market(columns: list[str], price: str = "close") -> tuple[list[dict], int]:
    first, out = {"_price_change": pct(price)}, {}
    for c in columns:
        first[f"{c}_return_1d"] = pct(c)
        out.update({f"{c}_sma_{n}": mean(c, n) for n in (50, 200)})
        out[f"{c}_momentum"] = pct(c, 20)
        out[f"{c}_volatility"] = std(f"{c}_return_1d", 20) * math.sqrt(252)
        out.update({f"{c}_price_corr_{n}": roll2(F.corr, "_price_change", f"{c}_return_1d", n) for n in (20, 60, 120)})

    def flag(cond: Column, yes, no) -> Column:
        return F.when(cond, yes).otherwise(no)

    if a := _pick(columns, "vix"):
        out["high_vol_regime"] = flag(F.col(a) > quantile(a, 252, 0.8), 1, 0)
        out["vix_trend"] = F.signum(F.col(a) - mean(a, 20))
    if a := _pick(columns, "usd"):
        out["usd_strength"] = flag(F.col(a) > mean(a, 50), 1, -1)
    if a := _pick(columns, "sp500") or _pick(columns, "spx"):
        out["risk_regime"] = flag(F.col(a) > mean(a, 200), "risk_on", "risk_off")
        out["risk_regime_num"] = flag(F.col(a) > mean(a, 200), 1, -1)
    if a := _pick(columns, "treasury") or _pick(columns, "rate"):
        out["rate_regime"] = flag(F.col(a) > lag(a, 20), "rising", "falling")
        out["rate_regime_num"] = flag(F.col(a) > lag(a, 20), 1, -1)
    if a := _pick(columns, "commodity"):
        out["commodity_trend"] = F.signum(F.col(a) - mean(a, 50))
    return [first, out], 252


def temporal(ts: str = "ts") -> dict[str, Column]:
    """Calendar features, scaled to about 0..1, and their circular forms. Monday is day 0."""
    t = F.col(ts)
    turn = lambda x, n: 2.0 * math.pi * x / n
    hour, dow, month = F.hour(t), F.weekday(t), F.month(t)
    return {
        "hour_of_day": hour / 23.0, "day_of_week": dow / 6.0, "day_of_month": F.dayofmonth(t) / 31.0, "month_of_year": month / 12.0,
        "week_of_year": F.weekofyear(t) / 53.0, "is_weekend": F.when(dow >= 5, 1.0).otherwise(0.0),
        "sin_hour": F.sin(turn(hour, 24)), "cos_hour": F.cos(turn(hour, 24)), "sin_day": F.sin(turn(dow, 7)), "cos_day": F.cos(turn(dow, 7)),
        "sin_month": F.sin(turn(month, 12)), "cos_month": F.cos(turn(month, 12)),
    }


def lags(wanted: dict[str, list[int]]) -> tuple[list[dict], int]:
    return [{f"{c}_lag_{k}": lag(c, k) for c, ks in wanted.items() for k in ks}], max(k for ks in wanted.values() for k in ks)


def differences(wanted: dict[str, list]) -> tuple[list[dict], int]:
    """Entries: an integer (difference), ``pct_k`` or ``log_k``."""
    out, deepest = {}, 1
    for c, items in wanted.items():
        for item in items:
            kind, _, k = str(item).rpartition("_")
            k = int(k)
            deepest = max(deepest, k)
            if kind == "":
                out[f"{c}_diff_{k}"] = diff(c, k)
            elif kind == "pct":
                out[f"{c}_pct_{k}"] = pct(c, k)
            else:
                out[f"{c}_logdiff_{k}"] = log_safe(div(c, lag(c, k)))
    return [out], deepest


def previous(target: str) -> tuple[list[dict], int]:
    return [{f"prev_{target}": lag(target)}], 1

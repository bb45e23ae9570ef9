"""Technical indicators over OHLCV bars.

Each function takes its temp-name helper and one period and yields the passes it needs
(see ``stages``). Output parts are the keys of the returned dict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import c, clip, div, log_safe, neg, pos, sqrt_safe
from ..functions.rolling import (
    block_window, diff, high, lag, lead, low, mean, pct, quantile, roll, roll2, std, total, var,
)
from . import machines
from .stages import Cum, Replay, Roll, Scan

CLOSE, OPEN, HIGH, LOW, VOLUME, RN = "close", "open", "high", "low", "volume", "_rn"


def ema_of(x, span: float | None = None, start: int = 1, alpha: float | None = None):
    """Recurrence pair of an exponential average whose first value is x at row ``start``."""
    x = c(x)
    alpha = alpha if alpha is not None else 2.0 / (span + 1.0)
    if alpha >= 1.0:  # span 1: the average is the series itself
        return 0.0, x
    step = F.when(F.col(RN) == start, x).when(F.col(RN) > start, alpha * x)
    return 1.0 - alpha, step


def typical() -> Column:
    return (F.col(HIGH) + F.col(LOW) + F.col(CLOSE)) / 3.0


def true_range() -> Column:
    prev = lag(CLOSE)
    return F.greatest(F.col(HIGH) - F.col(LOW), F.abs(F.col(HIGH) - prev), F.abs(F.col(LOW) - prev))


def money_multiplier() -> Column:
    span = F.col(HIGH) - F.col(LOW)
    return F.coalesce(div((F.col(CLOSE) - F.col(LOW)) - (F.col(HIGH) - F.col(CLOSE)), span), F.lit(0.0))


def ratio_index(up: Column, down: Column) -> Column:
    """100 - 100/(1 + up/down); 100 when only ``down`` is zero."""
    return F.when((down == 0) & (up > 0), F.lit(100.0)).otherwise(100.0 - div(100.0, 1.0 + div(up, down)))


# --- trend -----------------------------------------------------------------


def sma(t, n):
    yield Roll([{t("y"): mean(CLOSE, n)}], n - 1)
    return {"": t["y"]}


def ema(t, n):
    yield Scan({t("y"): ema_of(CLOSE, n)})
    return {"": t["y"]}


def wma(t, n):
    # sum of (position in block) * close gives linear weights after shifting by the frame start; positions in the series would cancel digits
    first = F.first(RN).over(block_window().rowsBetween(Window.unboundedPreceding, 0))
    weighted = total(t["at"] * F.col(CLOSE), n) - (t["at"] - n) * total(CLOSE, n)
    yield Roll([{t("at"): F.col(RN) - first + 1}, {t("y"): weighted / (n * (n + 1) / 2.0)}], n - 1)
    return {"": t["y"]}


def dema(t, n):
    yield Scan({t("e1"): ema_of(CLOSE, n)})
    yield Scan({t("e2"): ema_of(t["e1"], n)})
    return {"": 2.0 * t["e1"] - t["e2"]}


def tema(t, n):
    yield Scan({t("e1"): ema_of(CLOSE, n)})
    yield Scan({t("e2"): ema_of(t["e1"], n)})
    yield Scan({t("e3"): ema_of(t["e2"], n)})
    return {"": 3.0 * t["e1"] - 3.0 * t["e2"] + t["e3"]}


def trima(t, n):
    yield Roll([{t("s"): mean(CLOSE, n)}, {t("y"): mean(t["s"], n)}], 2 * n)
    return {"": t["y"]}


def kama(t, n):
    fast, slow = 2.0 / 3.0, 2.0 / 31.0
    yield Roll([
        {t("d"): F.abs(diff(CLOSE)), t("c"): F.abs(diff(CLOSE, n))},
        {t("er"): F.coalesce(div(t["c"], total(t["d"], n)), F.lit(0.0))},
        {t("sc"): F.pow(t["er"] * (fast - slow) + slow, 2.0)},
    ], n + 1)
    later = F.col(RN) > n
    step = F.when(F.col(RN) == n, F.col(CLOSE)).when(later, t["sc"] * F.col(CLOSE))
    yield Scan({t("y"): (F.when(later, 1.0 - t["sc"]).otherwise(1.0), step)})
    return {"": F.when(F.col(RN) >= n, t["y"])}


def macd(t, fast, slow=26, signal=9):
    yield Scan({t("f"): ema_of(CLOSE, fast), t("s"): ema_of(CLOSE, slow)})
    yield Scan({t("g"): ema_of(t["f"] - t["s"], signal)})
    line = t["f"] - t["s"]
    return {"macd": line, "signal": t["g"], "histogram": line - t["g"]}


def ppo(t, fast, slow=26):
    yield Scan({t("f"): ema_of(CLOSE, fast), t("s"): ema_of(CLOSE, slow)})
    return {"": 100.0 * div(t["f"] - t["s"], t["s"])}


def _directional(t):
    up, down = diff(HIGH), -diff(LOW)
    first = F.col(RN) == 1
    return {
        t("tr"): F.when(first, 0.0).otherwise(true_range()),
        t("pd"): F.when((up > down) & (up > 0), up).otherwise(0.0),
        t("md"): F.when((down > up) & (down > 0), down).otherwise(0.0),
    }


def adx(t, n):
    yield Roll([
        _directional(t),
        {t("p"): 100.0 * div(total(t["pd"], n), total(t["tr"], n)),
         t("m"): 100.0 * div(total(t["md"], n), total(t["tr"], n))},
        {t("dx"): 100.0 * div(F.abs(t["p"] - t["m"]), t["p"] + t["m"])},
        {t("y"): mean(t["dx"], n)},
    ], 2 * n + 1)
    return {"adx": t["y"], "plus_di": t["p"], "minus_di": t["m"]}


def adx_smoothed(t, n):
    """Exponentially smoothed form; the downward move looks back, not ahead."""
    up, down = diff(HIGH), F.abs(diff(LOW))
    yield Roll([{
        t("tr"): true_range(),
        t("pd"): F.when((up > down) & (up > 0), up).otherwise(0.0),
        t("md"): F.when((down > up) & (down > 0), down).otherwise(0.0),
    }], 1)
    yield Scan({t(k + "e"): ema_of(t[k], n) for k in ("tr", "pd", "md")})
    p, m = 100.0 * div(t["pde"], t["tre"]), 100.0 * div(t["mde"], t["tre"])
    dx = F.coalesce(100.0 * div(F.abs(p - m), p + m), F.lit(0.0))
    yield Scan({t("y"): ema_of(dx, n)})
    return {"adx": t["y"], "plus_di": p, "minus_di": m}


def heikin_ashi(t, n=1):
    ha_close = (F.col(OPEN) + F.col(HIGH) + F.col(LOW) + F.col(CLOSE)) / 4.0
    yield Roll([{t("prev"): lag(ha_close)}], 1)
    yield Scan({t("o"): (0.5, F.when(F.col(RN) == 1, F.col(OPEN)).otherwise(t["prev"] / 2.0))})
    return {
        "open": t["o"], "close": ha_close,
        "high": F.greatest(F.col(HIGH), t["o"], ha_close), "low": F.least(F.col(LOW), t["o"], ha_close),
    }


def parabolic_sar(t, af=0.02):
    yield Replay(machines.ParabolicSar(t("y"), af), [HIGH, LOW], {t("y"): T.DoubleType()})
    return {"": t["y"]}


def psar(t, af=0.02):
    names = {t(k): T.DoubleType() for k in ("psar", "up", "down")}
    yield Replay(machines.TwoSidedSar(list(names), af), [HIGH, LOW, CLOSE], names)
    return {"psar": t["psar"], "psar_up": t["up"], "psar_down": t["down"]}


def _cloud(t, conversion, base, span_b, shift):
    def mid(n):
        return (high(HIGH, n) + low(LOW, n)) / 2.0

    return Roll([
        {t("c"): mid(conversion), t("b"): mid(base), t("w"): mid(span_b), t("lead"): lead(CLOSE, shift)},
        {t("sa"): lag((t["c"] + t["b"]) / 2.0, shift), t("sb"): lag(t["w"], shift)},
    ], span_b + shift, shift)


def ichimoku(t, n):
    yield _cloud(t, n, 3 * n, 5 * n, 3 * n)
    return {"tenkan_sen": t["c"], "kijun_sen": t["b"], "senkou_span_a": t["sa"],
            "senkou_span_b": t["sb"], "chikou_span": t["lead"]}


def ichimoku_cloud(t, n=9, base=26, span_b=52, displacement=26):
    yield _cloud(t, n, base, span_b, displacement)
    return {"conversion_line": t["c"], "base_line": t["b"], "senkou_span_a": t["sa"],
            "senkou_span_b": t["sb"], "chikou_span": t["lead"]}


def supertrend(t, n, multiplier=3.0):
    yield Roll([{t("tr"): true_range()}, {t("atr"): mean(t["tr"], n)}], n)
    mid = (F.col(HIGH) + F.col(LOW)) / 2.0
    yield Roll([{t("u"): mid + multiplier * t["atr"], t("l"): mid - multiplier * t["atr"]}], 0)
    names = {t("v"): T.DoubleType(), t("d"): T.IntegerType()}
    yield Replay(machines.Supertrend(n, t("u"), t("l"), *names), [CLOSE, t("u"), t("l")], names)
    return {"supertrend": t["v"], "direction": t["d"]}


def awesome_oscillator(t, n=5, slow=34):
    mid = (F.col(HIGH) + F.col(LOW)) / 2.0
    yield Roll([{t("y"): mean(mid, n) - mean(mid, slow)}], slow - 1)
    return {"": t["y"]}


def trend_strength(t, n):
    yield Roll([{
        t("s"): roll2(F.regr_slope, CLOSE, RN, n), t("r"): roll2(F.corr, CLOSE, RN, n), t("m"): mean(CLOSE, n),
    }], n)
    return {"": F.when(F.col(RN) > n, F.abs(div(t["s"] * n, t["m"])) * t["r"] * t["r"])}


def price_momentum(t, n):
    yield Roll([{t("y"): div(diff(CLOSE, n), mean(CLOSE, n))}], n)
    return {"": t["y"]}


def roc(t, n):
    yield Roll([{t("y"): pct(CLOSE, n)}], n)
    return {"": 100.0 * t["y"]}


def relative_return(t, n):
    yield Roll([{t("y"): pct(CLOSE, n)}], n)
    return {"": t["y"]}


# --- momentum --------------------------------------------------------------


def _rsi_steps(t, n):
    return [
        {t("g"): pos(diff(CLOSE)), t("l"): neg(diff(CLOSE))},
        {t("rsi"): ratio_index(mean(t["g"], n), mean(t["l"], n))},
    ]


def rsi(t, n):
    yield Roll(_rsi_steps(t, n), n + 1)
    return {"": t["rsi"]}


def rsi_wilder(t, n):
    yield Roll([{t("g"): pos(diff(CLOSE)), t("l"): neg(diff(CLOSE))}], 1)
    yield Scan({t("ge"): ema_of(t["g"], start=2, alpha=1.0 / n), t("le"): ema_of(t["l"], start=2, alpha=1.0 / n)})
    return {"": F.when(F.col(RN) > n, ratio_index(t["ge"], t["le"]))}


def stoch(t, n, smooth=3):
    yield Roll([
        {t("k"): 100.0 * div(F.col(CLOSE) - low(LOW, n), high(HIGH, n) - low(LOW, n))},
        {t("d"): mean(t["k"], smooth)},
    ], n + smooth)
    return {"k": t["k"], "d": t["d"]}


def stochrsi(t, n):
    yield Roll([
        *_rsi_steps(t, n),
        {t("y"): div(t["rsi"] - low(t["rsi"], n), high(t["rsi"], n) - low(t["rsi"], n))},
    ], 2 * n + 1)
    return {"": t["y"]}


def williams(t, n):
    yield Roll([{t("y"): -100.0 * div(high(HIGH, n) - F.col(CLOSE), high(HIGH, n) - low(LOW, n))}], n - 1)
    return {"": t["y"]}


def cci(t, n):
    """Mean absolute deviation around the frame's own mean; the frame has ``n`` rows."""
    items = F.collect_list(t["tp"]).over(block_window().rowsBetween(-(n - 1), 0))
    yield Roll([
        {t("tp"): typical()},
        {t("m"): mean(t["tp"], n), t("i"): items},
        {t("md"): F.aggregate(t["i"], F.lit(0.0), lambda a, x: a + F.abs(x - t["m"])) / n},
    ], n - 1)
    return {"": div(t["tp"] - t["m"], 0.015 * t["md"])}


def cci_running(t, n):
    """Deviation of each row from the mean at that row, then averaged."""
    yield Roll([
        {t("tp"): typical()}, {t("m"): mean(t["tp"], n)}, {t("md"): mean(F.abs(t["tp"] - t["m"]), n)},
    ], 2 * n)
    return {"": div(t["tp"] - t["m"], 0.015 * t["md"])}


def mfi(t, n):
    up, down = t["tp"] > t["pv"], t["tp"] < t["pv"]
    flow = t["tp"] * F.col(VOLUME)
    yield Roll([
        {t("tp"): typical(), t("pv"): lag(typical())},
        {t("p"): F.when(up, flow).otherwise(0.0), t("m"): F.when(down, flow).otherwise(0.0)},
        {t("y"): ratio_index(total(t["p"], n), total(t["m"], n))},
    ], n + 1)
    return {"": t["y"]}


def tsi(t, n):
    short = n // 2
    yield Roll([{t("d"): diff(CLOSE)}], 1)
    yield Scan({t("a"): ema_of(t["d"], n, 2), t("b"): ema_of(F.abs(t["d"]), n, 2)})
    yield Scan({t("aa"): ema_of(t["a"], short, 2), t("bb"): ema_of(t["b"], short, 2)})
    return {"": F.when(F.col(RN) > 1, 100.0 * div(t["aa"], t["bb"]))}


def ultimate(t, n):
    yield Roll([
        {t("bp"): F.col(CLOSE) - F.least(F.col(LOW), lag(CLOSE)), t("tr"): true_range()},
        {t(f"a{k}"): div(total(t["bp"], k * n), total(t["tr"], k * n)) for k in (1, 2, 4)},
    ], 4 * n)
    return {"": 100.0 * (4.0 * t["a1"] + 2.0 * t["a2"] + t["a4"]) / 7.0}


def oscillator_divergence(t, n):
    side = max(3, n // 5)
    w = block_window()
    before, after, past = w.rowsBetween(-side, -1), w.rowsBetween(1, side), w.rowsBetween(-n, -side - 1)
    full = (F.count(CLOSE).over(before) == side) & (F.count(CLOSE).over(after) == side)
    price = F.col(CLOSE)
    point = F.struct(t["pk"].alias("pk"), t["tg"].alias("tg"), price.alias("x"), t["rsi"].alias("r"))
    yield Roll([
        *_rsi_steps(t, n),
        {t("pk"): full & (price > F.max(CLOSE).over(before)) & (price > F.max(CLOSE).over(after)),
         t("tg"): full & (price < F.min(CLOSE).over(before)) & (price < F.min(CLOSE).over(after))},
        {t("past"): F.collect_list(point).over(past)},
    ], 2 * n + side + 1, side)
    bear = F.exists(t["past"], lambda p: p["pk"] & (price > p["x"]) & (t["rsi"] < p["r"]))
    bull = F.exists(t["past"], lambda p: p["tg"] & (price < p["x"]) & (t["rsi"] > p["r"]))
    return {"": F.when(t["pk"] & bear, -1).when(t["tg"] & bull, 1).otherwise(0)}


# --- volatility and channels -------------------------------------------------


def atr(t, n):
    yield Roll([{t("tr"): true_range()}, {t("y"): mean(t["tr"], n)}], n)
    return {"": t["y"]}


def natr(t, n):
    yield Roll([{t("tr"): true_range()}, {t("y"): mean(t["tr"], n)}], n)
    return {"": 100.0 * div(t["y"], CLOSE)}


def atr_wilder(t, n):
    yield Roll([{t("tr"): true_range()}], 1)
    yield Scan({t("y"): ema_of(t["tr"], alpha=1.0 / n)})
    return {"": F.when(F.col(RN) >= n, t["y"])}


def bollinger(t, n, width=2.0):
    yield Roll([{t("m"): mean(CLOSE, n), t("s"): std(CLOSE, n)}], n - 1)
    up, down = t["m"] + width * t["s"], t["m"] - width * t["s"]
    return {"middle": t["m"], "upper": up, "lower": down}


def bollinger_shape(t, n, width=2.0):
    yield Roll([{t("m"): mean(CLOSE, n), t("s"): std(CLOSE, n)}], n - 1)
    up, down = t["m"] + width * t["s"], t["m"] - width * t["s"]
    return {"width": div(up - down, t["m"]), "pct": div(F.col(CLOSE) - down, up - down)}


def _keltner(t, n, basis, width):
    yield Roll([{t("tr"): true_range()}, {t("atr"): mean(t["tr"], n)}], n)
    yield Scan({t("m"): ema_of(basis, n)})
    return {"middle": t["m"], "upper": t["m"] + width * t["atr"], "lower": t["m"] - width * t["atr"]}


def keltner(t, n):
    return (yield from _keltner(t, n, F.col(CLOSE), 2.0))


def keltner_typical(t, n):
    return (yield from _keltner(t, n, typical(), 2.0))


def donchian(t, n):
    yield Roll([{t("u"): high(HIGH, n), t("l"): low(LOW, n)}], n - 1)
    return {"middle": (t["u"] + t["l"]) / 2.0, "upper": t["u"], "lower": t["l"]}


def vortex(t, n):
    yield Roll([
        {t("tr"): true_range(), t("p"): F.abs(F.col(HIGH) - lag(LOW)), t("m"): F.abs(F.col(LOW) - lag(HIGH))},
        {t("vp"): div(total(t["p"], n), total(t["tr"], n)), t("vm"): div(total(t["m"], n), total(t["tr"], n))},
    ], n + 1)
    return {"plus": t["vp"], "minus": t["vm"]}


def price_channels(t, n):
    yield Roll([{t("u"): high(HIGH, n), t("l"): low(LOW, n)}], n - 1)
    price = F.col(CLOSE)
    return {"dist_to_high": div(t["u"] - price, price), "dist_to_low": div(price - t["l"], price),
            "channel_pos": div(price - t["l"], t["u"] - t["l"])}


def historical_volatility(t, n):
    yield Roll([{t("r"): log_safe(div(CLOSE, lag(CLOSE)))}, {t("y"): std(t["r"], n)}], n + 1)
    return {"": t["y"] * math.sqrt(252)}


def volatility_ratio(t, n):
    short = max(5, n // 3)
    yield Roll([{t("r"): pct(CLOSE)}, {t("y"): div(std(t["r"], short), std(t["r"], n))}], max(n, short) + 1)
    return {"": t["y"]}


# --- volume ------------------------------------------------------------------


def _signed_volume() -> Column:
    return F.signum(diff(CLOSE)) * F.col(VOLUME)


def obv(t, n=1):
    yield Roll([{t("v"): F.coalesce(_signed_volume(), F.lit(0.0))}], 1)
    yield Cum({t("y"): ("sum", t["v"])})
    return {"": t["y"]}


def obv_seeded(t, n=1):
    """Starts at the first volume instead of zero."""
    yield Roll([{t("v"): F.coalesce(_signed_volume(), F.col(VOLUME))}], 1)
    yield Cum({t("y"): ("sum", t["v"])})
    return {"": t["y"]}


def vwap(t, n):
    yield Roll([{t("y"): div(total(typical() * F.col(VOLUME), n), total(VOLUME, n))}], n - 1)
    return {"": t["y"]}


def vwap_daily(t, n=1):
    """Cumulative within the day: the day is the partition, so no carry is needed."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    yield Roll([{}], 0)
    flow = F.sum(typical() * F.col(VOLUME)).over(w)
    return {"": div(flow, F.sum(VOLUME).over(w))}


def pvt(t, n=1):
    yield Roll([{t("v"): pct(CLOSE) * F.col(VOLUME)}], 1)
    yield Cum({t("y"): ("sum", t["v"])})
    return {"": t["y"]}


def cmf(t, n):
    yield Roll([{t("y"): div(total(money_multiplier() * F.col(VOLUME), n), total(VOLUME, n))}], n - 1)
    return {"": t["y"]}


def ad(t, n=1):
    yield Cum({t("y"): ("sum", money_multiplier() * F.col(VOLUME))})
    return {"": t["y"]}


def eom(t, n):
    mid = (F.col(HIGH) + F.col(LOW)) / 2.0
    box = div(F.col(VOLUME) / 1000000.0, F.col(HIGH) - F.col(LOW))
    yield Roll([{t("e"): div(diff(mid), box)}, {t("y"): mean(t["e"], n)}], n + 1)
    return {"": t["y"]}


def volume_pressure(t, n):
    yield Roll([
        {t("v"): pct(CLOSE) * F.col(VOLUME)},
        {t("y"): div(total(t["v"], n), total(VOLUME, n)) * div(VOLUME, mean(VOLUME, n))},
    ], n + 1)
    return {"": t["y"]}


def volume_features(t, n):
    yield Roll([{t("a"): mean(VOLUME, n), t("s5"): mean(VOLUME, 5), t("sd"): std(VOLUME, n)}], max(n, 5))
    out = {"sma": t["a"], "ratio": div(VOLUME, t["a"]), "std": t["sd"], "norm": div(VOLUME, t["a"])}
    if n > 10:
        out["osc"] = div(t["s5"], t["a"]) - 1.0
    return out


def spread_features(t, n=1):
    yield Roll([{}], 0)
    hl, oc = F.col(HIGH) - F.col(LOW), F.col(OPEN) - F.col(CLOSE)
    return {"hl_range": hl, "hl_range_pct": div(hl, CLOSE), "oc_range": oc, "oc_range_pct": div(oc, CLOSE),
            "body_ratio": F.coalesce(div(F.abs(oc), hl), F.lit(0.0))}


def price_volume_correlation(t, n):
    yield Roll([{t("r"): pct(CLOSE), t("v"): pct(VOLUME)}, {t("y"): roll2(F.corr, t["r"], t["v"], n)}], n + 1)
    return {"": t["y"]}


def loader_returns(t, n=7, slow=21):
    yield Roll([
        {t("r"): pct(CLOSE), t("l"): log_safe(div(CLOSE, lag(CLOSE)))},
        {t("a"): std(t["r"], n), t("b"): std(t["r"], slow)},
    ], slow + 1)
    return {"returns": t["r"], "log_returns": t["l"], f"volatility_{n}": t["a"], f"volatility_{slow}": t["b"]}


# --- patterns ------------------------------------------------------------------


def engulfing(t, n=1):
    o, k = F.col(OPEN), F.col(CLOSE)
    po, pk = t["po"], t["pk"]
    yield Roll([{t("po"): lag(OPEN), t("pk"): lag(CLOSE)}], 1)
    bigger = F.abs(k - o) > F.abs(pk - po)
    bull = (po > pk) & (k > o) & (o <= pk) & (k >= po) & bigger
    bear = (pk > po) & (o > k) & (o >= pk) & (k <= po) & bigger
    return {"": F.when(bull, 1).when(bear, -1).otherwise(0)}


def hammer(t, n=1):
    yield Roll([{}], 0)
    body = F.abs(F.col(CLOSE) - F.col(OPEN))
    upper = F.col(HIGH) - F.greatest(OPEN, CLOSE)
    lower = F.least(OPEN, CLOSE) - F.col(LOW)
    down = (lower > 2 * body) & (upper < 0.2 * body) & (body > 0)
    star = (upper > 2 * body) & (lower < 0.2 * body) & (body > 0)
    return {"": F.when(down, 1).when(star, -1).otherwise(0)}


def doji(t, n=1):
    yield Roll([{}], 0)
    body, span = F.abs(F.col(CLOSE) - F.col(OPEN)), F.col(HIGH) - F.col(LOW)
    return {"": F.when((body < 0.1 * span) & (span > 0), 1).otherwise(0)}


def pivot_points(t, n=1):
    yield Roll([{t("h"): lag(HIGH), t("l"): lag(LOW), t("c"): lag(CLOSE)}], 1)
    pp, span = (t["h"] + t["l"] + t["c"]) / 3.0, t["h"] - t["l"]
    s1, r1 = 2.0 * pp - t["h"], 2.0 * pp - t["l"]
    return {"pp": pp, "s1": s1, "s2": pp - span, "s3": s1 - span, "r1": r1, "r2": pp + span, "r3": r1 + span}


def support_resistance(t, n=1):
    """Nearest pivot level below and above the close."""
    levels = yield from pivot_points(t, n)
    ladder = F.array(*levels.values())
    price = F.col(CLOSE)
    return {"support": F.array_max(F.filter(ladder, lambda x: x < price)),
            "resistance": F.array_min(F.filter(ladder, lambda x: x > price))}


# --- statistics ------------------------------------------------------------------


def zscore(t, n):
    yield Roll([{t("y"): div(F.col(CLOSE) - mean(CLOSE, n), std(CLOSE, n))}], n - 1)
    return {"": t["y"]}


def variance(t, n):
    yield Roll([{t("y"): var(CLOSE, n)}], n - 1)
    return {"": t["y"]}


def kurtosis(t, n):
    yield Roll([{t("r"): pct(CLOSE)}, {t("y"): roll(F.kurtosis, t["r"], n)}], n + 1)
    return {"": t["y"]}


def skewness(t, n):
    yield Roll([{t("r"): pct(CLOSE)}, {t("y"): roll(F.skewness, t["r"], n)}], n + 1)
    return {"": t["y"]}


def _unbiased_skew(x, n):
    return roll(F.skewness, x, n) * (math.sqrt(n * (n - 1)) / (n - 2))


def _unbiased_kurt(x, n):
    return (roll(F.kurtosis, x, n) * (n + 1) + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))


ROLLING_STATS = {
    "mean": mean, "std": std, "var": var, "min": low, "max": high,
    "median": lambda x, n: quantile(x, n, 0.5),
    "skew": _unbiased_skew, "kurt": _unbiased_kurt,
    "q25": lambda x, n: quantile(x, n, 0.25), "q75": lambda x, n: quantile(x, n, 0.75),
}


def rolling_stats(t, n, column=CLOSE, stats=tuple(ROLLING_STATS)):
    yield Roll([{t(s): ROLLING_STATS[s](column, n) for s in stats}], n - 1)
    return {s: t[s] for s in stats}


def moments_moving_mean(t, n):
    """Skew and kurtosis of returns centred on their moving mean."""
    yield Roll([
        {t("r"): pct(CLOSE)},
        {t("d"): t["r"] - mean(t["r"], n)},
        {t(f"m{k}"): mean(F.pow(t["d"], F.lit(float(k))), n) for k in (2, 3, 4)},
    ], 2 * n + 1)
    return {"skew": div(t["m3"], F.pow(t["m2"], F.lit(1.5))), "kurt": div(t["m4"], t["m2"] * t["m2"]) - 3.0}


# --- microstructure -----------------------------------------------------------------


def vpin(t, n):
    d = t["d"]
    bought = F.when(d > 0, F.col(VOLUME)).when(d == 0, F.col(VOLUME) / 2.0).otherwise(0.0)
    sold = F.when(d < 0, F.col(VOLUME)).when(d == 0, F.col(VOLUME) / 2.0).otherwise(0.0)
    yield Roll([{t("d"): diff(CLOSE)}, {t("y"): div(total(F.abs(bought - sold), n), total(VOLUME, n))}], n + 1)
    return {"": t["y"]}


def kyle_lambda(t, n):
    yield Roll([
        {t("d"): diff(CLOSE), t("s"): _signed_volume()},
        {t("y"): roll2(F.regr_slope, t["d"], t["s"], n)},
    ], n + 1)
    return {"": t["y"]}


def kyle_ratio(t, n):
    yield Roll([{t("r"): div(F.abs(pct(CLOSE)), VOLUME)}, {t("y"): mean(t["r"], n)}], n + 1)
    return {"": t["y"]}


def amihud(t, n):
    money = F.col(CLOSE) * F.col(VOLUME) / 1000000.0
    yield Roll([{t("r"): div(F.abs(pct(CLOSE)), money)}, {t("y"): mean(t["r"], n)}], n + 1)
    return {"": t["y"]}


def roll_spread(t, n):
    yield Roll([
        {t("d"): diff(CLOSE)}, {t("p"): lag(t["d"])},
        {t("c"): roll2(F.covar_samp, t["d"], t["p"], n - 1), t("k"): F.count(t["d"]).over(
            block_window().rowsBetween(-(n - 1), 0))},
    ], n + 2)
    return {"": F.when(t["k"] == n, 2.0 * sqrt_safe(-t["c"]))}


def range_volatility(t, n):
    """Realized, Parkinson and Garman-Klass, annualised over 252."""
    hl, co = log_safe(div(HIGH, LOW)), log_safe(div(CLOSE, OPEN))
    gk = 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co
    yield Roll([
        {t("r"): log_safe(div(CLOSE, lag(CLOSE)))},
        {t("s"): std(t["r"], n), t("p"): mean(hl * hl, n), t("g"): mean(gk, n)},
    ], n + 1)
    return {"realized": t["s"] * math.sqrt(252), "parkinson": F.sqrt(252.0 / (4.0 * math.log(2.0)) * t["p"]),
            "garman_klass": sqrt_safe(252.0 * t["g"])}


def volume_weighted_volatility(t, n):
    yield Roll([
        {t("v"): pct(CLOSE) * F.col(VOLUME)}, {t("m"): mean(t["v"], n)},
        {t("y"): mean(F.pow(t["v"] - t["m"], 2.0), n)},
    ], 2 * n + 1)
    return {"": F.sqrt(t["y"])}


def tick_rule(t, n):
    yield Roll([{t("s"): F.nullif(F.signum(diff(CLOSE)), F.lit(0.0))}], 1)
    yield Cum({t("f"): ("last", t["s"])})
    yield Roll([{t("y"): total(t["f"], n)}], n - 1)
    return {"rule": t["f"], "sum": t["y"], "indicator": t["y"] / n}


def efficiency_coefficient(t, n):
    """Variance over the frame against ``n`` times the two-row variance."""
    yield Roll([{t("r"): pct(CLOSE)}, {t("y"): div(var(t["r"], n), var(t["r"], 2) * n)}], n + 1)
    return {"": t["y"]}


def semi_volatility(t, n):
    k = math.sqrt(252)
    yield Roll([
        {t("r"): pct(CLOSE)},
        {t("u"): std(pos(t["r"]), n) * k, t("d"): std(neg(t["r"]), n) * k},
    ], n + 1)
    return {"up": t["u"], "down": t["d"], "ratio": div(t["u"], t["d"])}


def reversals(t, n):
    """Direction changes, their frequency and the mean length of runs of one direction."""
    yield Roll([
        {t("s"): F.signum(diff(CLOSE))}, {t("p"): lag(t["s"])},
        {t("x"): F.when(t["s"].isNull() | t["p"].isNull() | (t["s"] != t["p"]), 1.0).otherwise(0.0)},
    ], 2)
    yield Cum({t("st"): ("max", F.when(t["x"] == 1.0, F.col(RN)))})
    run = (F.col(RN) - t["st"] + 1).cast("double")
    run = F.when(t["s"].isNotNull(), run)
    yield Roll([{t("f"): mean(t["x"], n), t("m"): mean(run, n)}], n - 1)
    return {"reversal": t["x"], "freq": t["f"], "consec": t["m"]}


def volume_bucket_vpin(t, n=50):
    """Imbalance per filled volume bucket; ``bucket`` is the bucket volume per symbol."""
    yield Roll([{t("d"): diff(CLOSE)}], 1)
    yield Replay(machines.VolumeBuckets(t("d"), t("v")), [t("d"), VOLUME, "bucket"], {t("v"): T.DoubleType()})
    w = block_window().rowsBetween(-(n - 1), 0)
    yield Roll([{t("y"): F.avg(t["v"]).over(w)}], n - 1)
    return {"": t["y"]}


# --- cross-asset: the reference series is the column ``ref`` -----------------------------


def correlation(t, n):
    yield Roll([{t("y"): roll2(F.corr, CLOSE, "ref", n)}], n - 1)
    return {"": t["y"]}


def relative_performance(t, n=1):
    yield Cum({t("c"): ("first", F.col(CLOSE)), t("r"): ("first", F.col("ref"))})
    return {"": div(div(CLOSE, t["c"]), div("ref", t["r"]))}


def beta(t, n):
    yield Roll([{t("r"): pct(CLOSE), t("m"): pct("ref")}, {t("y"): roll2(F.regr_slope, t["r"], t["m"], n)}], n + 1)
    return {"": t["y"]}

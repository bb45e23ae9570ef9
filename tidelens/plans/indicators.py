"""Indicator queries: hourly bars per event type (or daily bars per brand)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd_up
from ..operators import registry
from ..sources import bars as B
from .catalog import add
from .sqlkit import D, L, LEAD, OVER, PCT, R, R2, TP, TR, ema, over_bars, ratio_index, recur, rows, running


def _shape(df, digits, ints=()):
    cols = []
    for n in df.columns:
        if n in ("symbol", "ts"):
            cols.append(F.col(n))
        elif n in ints or df.schema[n].dataType.typeName() == "integer":
            cols.append(F.col(n).cast("int").alias(n))
        else:
            cols.append(rnd_up(n, digits).alias(n))
    return df.select(*cols)


def _reference(bars):
    """Joins the mean close of all symbols at the same time as ``ref``."""
    ref = bars.groupBy("ts").agg(F.avg(F.col("close").cast("decimal(20,6)")).cast("double").alias("ref"))
    return bars.join(ref, "ts")


def _bucketed(bars):
    """Joins the bucket volume: a fiftieth of the mean daily volume of the symbol."""
    daily = bars.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.sum("volume").alias("v"))
    return bars.join(daily.groupBy("symbol").agg((F.avg("v") / 50.0).alias("bucket")), "symbol")


def _ind(query, covers, name, period, steps, outs, digits=6, ints=(), source="event", prepare=None, label=None, more=None,
         **options):
    def run(spark, root):
        bars = B.event_bars(spark, root) if source == "event" else B.brand_bars(spark, root)
        if prepare:
            bars = prepare(bars)
        bars = B.numbered(bars, "1h" if source == "event" else "1d")
        df = registry.indicator_frame(bars, name, period, label or name, **options)
        return _shape(df, digits, ints)

    sql = None
    if outs is not None:
        from .sqlkit import BRAND_BARS, EVENT_BARS

        bars_sql = more or (EVENT_BARS if source == "event" else BRAND_BARS)
        sql = over_bars(steps, outs, digits, bars_sql, ints)
    add(query, covers, run, sql)


REF_BARS = """bars0 AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close,
         sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2),
refs AS (SELECT ts, avg(close) AS ref FROM bars0 GROUP BY ts),
bars AS (SELECT b.*, r.ref FROM bars0 b JOIN refs r USING (ts))"""

N = 14
# trend
_ind("sma", "TI-1", "sma", N, [], {"sma": R("avg", "close", N)}, source="brand")
_ind("ema", "TI-2", "ema", N, [recur(ema("t.close", N, "e"))], {"ema": "e"})
_ind("wma", "TI-3", "wma", N, [], {"wma": "(" + " + ".join(f"{L('close', k)} * {N - k}" if k else f"close * {N}" for k in range(N)) + f") / {N * (N + 1) / 2}"}, 5)
_ind("dema", "TI-4", "dema", N, [recur(ema("t.close", N, "e1")), recur(ema("t.e1", N, "e2"))], {"dema": "2 * e1 - e2"})
_ind("tema", "TI-5", "tema", N, [recur(ema("t.close", N, "e1")), recur(ema("t.e1", N, "e2")), recur(ema("t.e2", N, "e3"))],
     {"tema": "3 * e1 - 3 * e2 + e3"})
_ind("trima", "TI-6", "trima", N, [{"s": R("avg", "close", N)}], {"trima": R("avg", "s", N)})
_ind("kama", "TI-7", "kama", N, [
    {"d": f"abs(close - {L('close')})", "ch": f"abs(close - {L('close', N)})"},
    {"sc": f"pow(coalesce({D('ch', R('sum', 'd', N))}, 0) * (2.0/3 - 2.0/31) + 2.0/31, 2)"},
    recur({"k": ("NULL", f"CASE WHEN t.rn = {N} THEN t.close WHEN t.rn > {N} THEN p.k + t.sc * (t.close - p.k) END")}),
], {"kama": "k"})
_ind("macd", "TI-8", "macd", 12, [recur({**ema("t.close", 12, "f"), **ema("t.close", 26, "sl")}), recur(ema("(t.f - t.sl)", 9, "g"))],
     {"macd_macd": "f - sl", "macd_signal": "g", "macd_histogram": "f - sl - g"})
_ind("ppo", "TI-9", "ppo", 12, [recur({**ema("t.close", 12, "f"), **ema("t.close", 26, "sl")})], {"ppo": "100 * " + D("f - sl", "sl")})
_DM = {
    "tr": f"CASE WHEN rn = 1 THEN 0 ELSE {TR} END",
    "pd": f"CASE WHEN high - {L('high')} > {L('low')} - low AND high - {L('high')} > 0 THEN high - {L('high')} ELSE 0 END",
    "md": f"CASE WHEN {L('low')} - low > high - {L('high')} AND {L('low')} - low > 0 THEN {L('low')} - low ELSE 0 END",
}
_ind("adx", "TI-10", "adx", N, [
    _DM, {"pdi": "100 * " + D(R("sum", "pd", N), R("sum", "tr", N)), "mdi": "100 * " + D(R("sum", "md", N), R("sum", "tr", N))},
    {"dx": "100 * " + D("abs(pdi - mdi)", "pdi + mdi")},
], {"adx_adx": R("avg", "dx", N), "adx_plus_di": "pdi", "adx_minus_di": "mdi"})
_ind("adx_smoothed", "TI-11", "adx_smoothed", N, [
    {"tr": TR, "u": f"high - {L('high')}", "w": f"abs(low - {L('low')})"},
    {"pd": "CASE WHEN u > w AND u > 0 THEN u ELSE 0 END", "md": "CASE WHEN w > u AND w > 0 THEN w ELSE 0 END"},
    recur({**ema("t.tr", N, "te"), **ema("t.pd", N, "pe"), **ema("t.md", N, "me")}),
    {"pdi": "100 * " + D("pe", "te"), "mdi": "100 * " + D("me", "te")},
    {"dx": f"coalesce(100 * {D('abs(pdi - mdi)', 'pdi + mdi')}, 0)"}, recur(ema("t.dx", N, "ax")),
], {"adx_smoothed_adx": "ax", "adx_smoothed_plus_di": "pdi", "adx_smoothed_minus_di": "mdi"})
_ind("heikin_ashi", "TI-12", "heikin_ashi", 1, [
    {"hc": "(open + high + low + close) / 4"}, {"pc": L("hc")}, recur({"ho": ("t.open", "(p.ho + t.pc) / 2")}),
], {"heikin_ashi_open": "ho", "heikin_ashi_close": "hc", "heikin_ashi_high": "greatest(high, ho, hc)", "heikin_ashi_low": "least(low, ho, hc)"})
_SAR_UP = "least(p.sar + p.af * (p.ext - p.sar), p.l1, p.l2)"
_SAR_DN = "greatest(p.sar + p.af * (p.ext - p.sar), p.h1, p.h2)"
_FLIP = f"(CASE WHEN p.tr > 0 THEN t.low < {_SAR_UP} ELSE t.high > {_SAR_DN} END)"


def _sar_fields(first_trend, first_sar, first_ext):
    return {
        "tr": (first_trend, f"CASE WHEN {_FLIP} THEN -p.tr ELSE p.tr END"),
        "sar": (first_sar, f"CASE WHEN {_FLIP} THEN p.ext WHEN p.tr > 0 THEN {_SAR_UP} ELSE {_SAR_DN} END"),
        "ext": (first_ext, f"CASE WHEN {_FLIP} AND p.tr > 0 THEN t.low WHEN {_FLIP} THEN t.high WHEN p.tr > 0 THEN greatest(p.ext, t.high) ELSE least(p.ext, t.low) END"),
        "af": ("0.02", f"CASE WHEN {_FLIP} THEN 0.02 WHEN (p.tr > 0 AND t.high > p.ext) OR (p.tr < 0 AND t.low < p.ext) THEN least(p.af + 0.02, 0.2) ELSE p.af END"),
        "l1": ("t.low", "t.low"), "l2": ("t.low", "p.l1"), "h1": ("t.high", "t.high"), "h2": ("t.high", "p.h1"),
    }


_ind("parabolic_sar", "TI-13", "parabolic_sar", 0.02, [recur(_sar_fields("1", "t.low", "t.high"))], {"parabolic_sar": "sar"})
_TWO = _sar_fields("0", "NULL", "NULL")
_INIT = {"tr": "CASE WHEN t.close > t.pc THEN 1 ELSE -1 END", "sar": "CASE WHEN t.close > t.pc THEN p.l1 ELSE p.h1 END",
         "ext": "CASE WHEN t.close > t.pc THEN t.high ELSE t.low END", "af": "0.02"}
_ind("psar_two_sided", "TI-14", "psar", 0.02, [
    {"pc": L("close")},
    recur({k: (f, f"CASE WHEN t.rn = 2 THEN {_INIT[k]} ELSE {x} END" if k in _INIT else x) for k, (f, x) in _TWO.items()}),
], {"psar_psar": "sar", "psar_psar_up": "CASE WHEN tr > 0 THEN sar END", "psar_psar_down": "CASE WHEN tr < 0 THEN sar END"})


def _mid(n):
    return f"({R('max', 'high', n)} + {R('min', 'low', n)}) / 2"


_ind("ichimoku", "TI-15", "ichimoku", 9, [{"a": _mid(9), "b": _mid(27), "w": _mid(45)}, {"ab": "(a + b) / 2"}],
     {"ichimoku_tenkan_sen": "a", "ichimoku_kijun_sen": "b", "ichimoku_senkou_span_a": L("ab", 27), "ichimoku_senkou_span_b": L("w", 27),
      "ichimoku_chikou_span": LEAD("close", 27)})
_ind("ichimoku_cloud", "TI-16", "ichimoku_cloud", 9, [{"a": _mid(9), "b": _mid(26), "w": _mid(52)}, {"ab": "(a + b) / 2"}],
     {"ichimoku_cloud_conversion_line": "a", "ichimoku_cloud_base_line": "b", "ichimoku_cloud_senkou_span_a": L("ab", 26),
      "ichimoku_cloud_senkou_span_b": L("w", 26), "ichimoku_cloud_chikou_span": LEAD("close", 26)})
_UP = "(CASE WHEN t.u < p.v OR p.c1 > p.v THEN t.u ELSE p.v END)"
_DN = "(CASE WHEN t.l > p.v OR p.c1 < p.v THEN t.l ELSE p.v END)"
_UPWARD = f"(CASE WHEN p.v = {_UP} THEN t.close > {_UP} ELSE NOT t.close < {_DN} END)"
_ind("supertrend", "TI-17", "supertrend", 10, [
    {"tr0": TR}, {"atr": R("avg", "tr0", 10)}, {"u": "(high + low) / 2 + 3 * atr", "l": "(high + low) / 2 - 3 * atr"},
    recur({
        "v": ("0", f"CASE WHEN t.rn < 11 THEN 0 WHEN t.rn = 11 THEN CASE WHEN t.close > t.u THEN t.l ELSE t.u END WHEN {_UPWARD} THEN {_DN} ELSE {_UP} END"),
        "di": ("1", f"CASE WHEN t.rn <= 11 THEN 1 WHEN {_UPWARD} THEN 1 ELSE -1 END"),
        "c1": ("t.close", "t.close"),
    }),
], {"supertrend_supertrend": "v", "supertrend_direction": "di"}, ints=("supertrend_direction",))
_ind("awesome_oscillator", "TI-18", "awesome_oscillator", 5, [{"m": "(high + low) / 2"}], {"awesome_oscillator": R("avg", "m", 5) + " - " + R("avg", "m", 34)})
_ind("trend_strength", "TI-19", "trend_strength", N, [],
     {"trend_strength": f"CASE WHEN rn > {N} THEN abs({R2('regr_slope', 'close', 'rn', N)} * {N} / {R('avg', 'close', N)}) * pow({R2('corr', 'close', 'rn', N)}, 2) END"})
_ind("price_momentum", "TI-20", "price_momentum", N, [], {"price_momentum": D(f"close - {L('close', N)}", R("avg", "close", N))})
_ind("roc", "TI-21", "roc", 10, [], {"roc": "100 * " + PCT("close", 10)}, 4)
_ind("relative_return", "TI-21", "relative_return", 5, [], {"relative_return": PCT("close", 5)})

# momentum
_GL = [{"dl": f"close - {L('close')}"}, {"g": "CASE WHEN dl > 0 THEN dl WHEN dl IS NOT NULL THEN 0 END", "ls": "CASE WHEN dl < 0 THEN -dl WHEN dl IS NOT NULL THEN 0 END"}]
_RSI = [*_GL, {"rsi0": ratio_index(R("avg", "g", N), R("avg", "ls", N))}]
_ind("rsi", "MO-1", "rsi", N, _RSI, {"rsi": "rsi0"}, source="brand")
_ind("rsi_wilder", "FE-11", "rsi_wilder", N, [*_GL, recur({**ema("t.g", 0, "ge", 2, "(1.0/14)"), **ema("t.ls", 0, "le", 2, "(1.0/14)")})],
     {"rsi_wilder": f"CASE WHEN rn > {N} THEN {ratio_index('ge', 'le')} END"})
_K = {"k": "100 * " + D(f"close - {R('min', 'low', N)}", f"{R('max', 'high', N)} - {R('min', 'low', N)}")}
_ind("stoch", "MO-2", "stoch", N, [_K], {"stoch_k": "k", "stoch_d": R("avg", "k", 3)})
_ind("stochrsi", "MO-3", "stochrsi", N, _RSI, {"stochrsi": D(f"rsi0 - {R('min', 'rsi0', N)}", f"{R('max', 'rsi0', N)} - {R('min', 'rsi0', N)}")})
_ind("williams", "MO-4", "williams", N, [], {"williams": "-100 * " + D(f"{R('max', 'high', N)} - close", f"{R('max', 'high', N)} - {R('min', 'low', N)}")})
_ind("cci", "MO-5", "cci", N, [
    {"tp": TP}, {"m": R("avg", "tp", N), "li": f"list(tp) {rows(N)}"},
    {"md": f"list_sum(list_transform(li, lambda x: abs(x - m))) / {N}"}], {"cci": D("tp - m", "0.015 * md")}, 4)
_ind("cci_running", "MO-6", "cci_running", 20, [{"tp": TP}, {"m": R("avg", "tp", 20)}, {"ad": "abs(tp - m)"}],
     {"cci_running": D("tp - m", f"0.015 * {R('avg', 'ad', 20)}")}, 4)
_ind("mfi", "MO-7", "mfi", N, [
    {"tp": TP}, {"pt": L("tp")},
    {"pf": "CASE WHEN tp > pt THEN tp * volume ELSE 0 END", "nf": "CASE WHEN tp < pt THEN tp * volume ELSE 0 END"}],
    {"mfi": ratio_index(R("sum", "pf", N), R("sum", "nf", N))})
_ind("tsi", "MO-8", "tsi", N, [
    {"dl": f"close - {L('close')}"}, {"ab": "abs(dl)"}, recur({**ema("t.dl", N, "a1", 2), **ema("t.ab", N, "b1", 2)}),
    recur({**ema("t.a1", 7, "a2", 2), **ema("t.b1", 7, "b2", 2)})], {"tsi": "100 * " + D("a2", "b2")})
_ind("ultimate", "MO-9", "ultimate", 7, [
    {"bp": f"close - least(low, {L('close')})", "tr": TR}],
    {"ultimate": "100 * (4 * " + D(R("sum", "bp", 7), R("sum", "tr", 7)) + " + 2 * " + D(R("sum", "bp", 14), R("sum", "tr", 14)) + " + " + D(R("sum", "bp", 28), R("sum", "tr", 28)) + ") / 7"})
_B3, _A3 = OVER.format(" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"), OVER.format(" ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING")
_FULL = f"count(close) {_B3} = 3 AND count(close) {_A3} = 3"
_ind("oscillator_divergence", "MO-10", "oscillator_divergence", N, [
    *_RSI,
    {"pk": f"({_FULL} AND close > max(close) {_B3} AND close > max(close) {_A3})",
     "tg": f"({_FULL} AND close < min(close) {_B3} AND close < min(close) {_A3})"},
    "{this} AS (SELECT a.*, CASE WHEN a.pk AND EXISTS (SELECT 1 FROM {prev} b WHERE b.symbol = a.symbol AND b.rn BETWEEN a.rn - 14 AND a.rn - 4 AND b.pk AND a.close > b.close AND a.rsi0 < b.rsi0) THEN -1 "
    "WHEN a.tg AND EXISTS (SELECT 1 FROM {prev} b WHERE b.symbol = a.symbol AND b.rn BETWEEN a.rn - 14 AND a.rn - 4 AND b.tg AND a.close < b.close AND a.rsi0 > b.rsi0) THEN 1 ELSE 0 END AS dv FROM {prev} a)",
], {"oscillator_divergence": "dv"}, ints=("oscillator_divergence",))

# volatility and channels
_ATR = [{"tr": TR}]
_ind("atr", "VO-1", "atr", N, _ATR, {"atr": R("avg", "tr", N)})
_ind("natr", "VO-1", "natr", N, _ATR, {"natr": "100 * " + D(R("avg", "tr", N), "close")}, 4)
_ind("atr_wilder", "FE-11", "atr_wilder", N, [*_ATR, recur(ema("t.tr", 0, "e", 1, "(1.0/14)"))], {"atr_wilder": f"CASE WHEN rn >= {N} THEN e END"})
_BB = [{"m": R("avg", "close", 20), "sd": R("stddev_samp", "close", 20)}]
_ind("bollinger", "VO-2", "bollinger", 20, _BB, {"bollinger_middle": "m", "bollinger_upper": "m + 2 * sd", "bollinger_lower": "m - 2 * sd"}, source="brand")
_ind("bollinger_shape", "VO-2", "bollinger_shape", 20, _BB, {"bollinger_shape_width": D("4 * sd", "m"), "bollinger_shape_pct": D("close - m + 2 * sd", "4 * sd")})
for _nm, _x in (("keltner", "t.close"), ("keltner_typical", "t.tp")):
    _ind(_nm, "VO-3", _nm, 20, [{"tr": TR, "tp": TP}, {"atr_": R("avg", "tr", 20)}, recur(ema(_x, 20, "e"))],
         {f"{_nm}_middle": "e", f"{_nm}_upper": "e + 2 * atr_", f"{_nm}_lower": "e - 2 * atr_"})
_ind("donchian", "VO-4", "donchian", 20, [], {"donchian_middle": _mid(20), "donchian_upper": R("max", "high", 20), "donchian_lower": R("min", "low", 20)})
_ind("vortex", "VO-5", "vortex", N, [{"tr": TR, "vp": f"abs(high - {L('low')})", "vm": f"abs(low - {L('high')})"}],
     {"vortex_plus": D(R("sum", "vp", N), R("sum", "tr", N)), "vortex_minus": D(R("sum", "vm", N), R("sum", "tr", N))})
_ind("price_channels", "VO-6", "price_channels", 20, [{"u": R("max", "high", 20), "w": R("min", "low", 20)}],
     {"price_channels_dist_to_high": D("u - close", "close"), "price_channels_dist_to_low": D("close - w", "close"), "price_channels_channel_pos": D("close - w", "u - w")}, 5)
_ind("historical_volatility", "VO-7", "historical_volatility", 20, [{"lr": f"ln({D('close', L('close'))})"}], {"historical_volatility": f"{R('stddev_samp', 'lr', 20)} * sqrt(252)"}, source="brand")
_RET = {"rt": PCT("close")}
_ind("volatility_ratio", "VO-8", "volatility_ratio", 15, [_RET], {"volatility_ratio": D(R("stddev_samp", "rt", 5), R("stddev_samp", "rt", 15))})

# volume
_SV = {"sv": f"sign(close - {L('close')}) * volume"}
_ind("obv", "VO-9", "obv", 1, [_SV], {"obv": f"sum(coalesce(sv, 0)) {running()}"})
_ind("obv_seeded", "VO-9", "obv_seeded", 1, [_SV], {"obv_seeded": f"sum(coalesce(sv, volume)) {running()}"})
_ind("vwap", "VO-10", "vwap", 20, [{"pv": f"{TP} * volume"}], {"vwap": D(R("sum", "pv", 20), R("sum", "volume", 20))})
_DAY = "OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ind("vwap_daily", "VO-11", "vwap_daily", 1, [], {"vwap_daily": D(f"sum({TP} * volume) {_DAY}", f"sum(volume) {_DAY}")})
_ind("pvt", "VO-12", "pvt", 1, [{"v": PCT("close") + " * volume"}], {"pvt": f"sum(v) {running()}"}, 3)
_MFM = {"mv": f"coalesce({D('(close - low) - (high - close)', 'high - low')}, 0) * volume"}
_ind("cmf", "VO-13", "cmf", 20, [_MFM], {"cmf": D(R("sum", "mv", 20), R("sum", "volume", 20))})
_ind("ad_line", "VO-14", "ad", 1, [_MFM], {"ad": f"sum(mv) {running()}"}, 4)
_ind("eom", "VO-15", "eom", N, [{"md": "(high + low) / 2"}, {"e": D(f"md - {L('md')}", D("volume / 1000000.0", "high - low"))}], {"eom": R("avg", "e", N)}, 1)
_ind("volume_pressure", "VO-16", "volume_pressure", N, [{"v": PCT("close") + " * volume"}],
     {"volume_pressure": D(R("sum", "v", N), R("sum", "volume", N)) + " * " + D("volume", R("avg", "volume", N))}, 4)
_ind("volume_features", "VO-17", "volume_features", 20, [{"va": R("avg", "volume", 20)}],
     {"volume_features_sma": "va", "volume_features_ratio": D("volume", "va"), "volume_features_std": R("stddev_samp", "volume", 20),
      "volume_features_norm": D("volume", "va"), "volume_features_osc": D(R("avg", "volume", 5), "va") + " - 1"})
_ind("spread_features", "VO-18", "spread_features", 1, [],
     {"spread_features_hl_range": "high - low", "spread_features_hl_range_pct": D("high - low", "close"), "spread_features_oc_range": "open - close",
      "spread_features_oc_range_pct": D("open - close", "close"), "spread_features_body_ratio": f"coalesce({D('abs(open - close)', 'high - low')}, 0)"}, 5)
_ind("price_volume_correlation", "VO-19", "price_volume_correlation", 20, [{"a": PCT("close"), "b": PCT("volume")}],
     {"price_volume_correlation": R2("corr", "a", "b", 20)}, source="brand")
_ind("loader_returns", "VO-20", "loader_returns", 7, [{**_RET, "lr": f"ln({D('close', L('close'))})"}],
     {"loader_returns_returns": "rt", "loader_returns_log_returns": "lr", "loader_returns_volatility_7": R("stddev_samp", "rt", 7),
      "loader_returns_volatility_21": R("stddev_samp", "rt", 21)}, 5, source="brand")

# patterns
_PO, _PC = L("open"), L("close")
_BIG = f"abs(close - open) > abs({_PC} - {_PO})"
_ind("engulfing", "PT-1", "engulfing", 1, [], {"engulfing": f"CASE WHEN {_PO} > {_PC} AND close > open AND open <= {_PC} AND close >= {_PO} AND {_BIG} THEN 1 "
     f"WHEN {_PC} > {_PO} AND open > close AND open >= {_PC} AND close <= {_PO} AND {_BIG} THEN -1 ELSE 0 END"}, ints=("engulfing",))
_ind("hammer", "PT-2", "hammer", 1, [{"bd": "abs(close - open)", "us": "high - greatest(open, close)", "lsh": "least(open, close) - low"}],
     {"hammer": "CASE WHEN lsh > 2 * bd AND us < 0.2 * bd AND bd > 0 THEN 1 WHEN us > 2 * bd AND lsh < 0.2 * bd AND bd > 0 THEN -1 ELSE 0 END"}, ints=("hammer",))
_ind("doji", "PT-3", "doji", 1, [], {"doji": "CASE WHEN abs(close - open) < 0.1 * (high - low) AND high > low THEN 1 ELSE 0 END"}, ints=("doji",))
_PV = [{"ph": L("high"), "pl": L("low"), "pc": L("close")}, {"pp": "(ph + pl + pc) / 3"}]
_LEVELS = {"pp": "pp", "s1": "2 * pp - ph", "s2": "pp - (ph - pl)", "s3": "2 * pp - ph - (ph - pl)", "r1": "2 * pp - pl", "r2": "pp + (ph - pl)", "r3": "2 * pp - pl + (ph - pl)"}
_ind("pivot_points", "PT-4", "pivot_points", 1, _PV, {f"pivot_points_{k}": v for k, v in _LEVELS.items()})
_ind("support_resistance", "PT-5", "support_resistance", 1, [*_PV, {"lv": "[" + ", ".join(_LEVELS.values()) + "]"}],
     {"support_resistance_support": "list_max(list_filter(lv, lambda x: x < close))", "support_resistance_resistance": "list_min(list_filter(lv, lambda x: x > close))"})

# statistics
_ind("zscore", "ST-1", "zscore", 20, _BB, {"zscore": D("close - m", "sd")}, source="brand")
_ind("rolling_variance", "ST-2", "variance", 20, [], {"variance": R("var_samp", "close", 20)}, 1, source="brand")
_ind("rolling_kurtosis", "ST-3", "kurtosis", 20, [_RET], {"kurtosis": R("kurtosis_pop", "rt", 20)}, source="brand")
_ind("rolling_skewness", "ST-4", "skewness", 20, [_RET], {"skewness": f"{R('skewness', 'rt', 20)} * 18 / sqrt(20 * 19.0)"}, source="brand")
_ind("rolling_stats", "ST-5", "rolling_stats", 20, [], {
    **{f"rolling_stats_{k}": R(a, "close", 20) for k, a in (("mean", "avg"), ("std", "stddev_samp"), ("var", "var_samp"), ("min", "min"), ("max", "max"), ("median", "median"), ("skew", "skewness"), ("kurt", "kurtosis"))},
    **{f"rolling_stats_q{q}": f"(CASE WHEN count(close) {rows(20)} = 20 THEN quantile_cont(close, 0.{q}) {rows(20)} END)" for q in ("25", "75")}}, 4)
_ind("moments_moving_mean", "ST-6", "moments_moving_mean", 20, [_RET, {"dv": f"rt - {R('avg', 'rt', 20)}"}, {"d2": "pow(dv, 2)", "d3": "pow(dv, 3)", "d4": "pow(dv, 4)"}],
     {"moments_moving_mean_skew": D(R("avg", "d3", 20), f"pow({R('avg', 'd2', 20)}, 1.5)"), "moments_moving_mean_kurt": D(R("avg", "d4", 20), f"pow({R('avg', 'd2', 20)}, 2)") + " - 3"}, 5, source="brand")

# microstructure
_ind("vpin_bars", "MS-1", "vpin", 50, [{"dl": f"close - {L('close')}"}, {"im": "CASE WHEN dl <> 0 THEN volume ELSE 0 END"}], {"vpin": D(R("sum", "im", 50), R("sum", "volume", 50))})
_ind("vpin_buckets", "MS-2", "volume_bucket_vpin", 50, [
    {"dl": f"close - {L('close')}"},
    recur({
        "net": ("0", "CASE WHEN p.full > 0 THEN 0 ELSE p.net END + sign(t.dl) * t.volume"),
        "seen": ("0", "CASE WHEN p.full > 0 THEN 0 ELSE p.seen END + t.volume"),
        "full": ("0", "CASE WHEN CASE WHEN p.full > 0 THEN 0 ELSE p.seen END + t.volume >= t.bucket THEN 1 ELSE 0 END"),
    }),
    {"v": f"CASE WHEN rn > 1 AND \"full\" > 0 THEN coalesce({D('abs(net)', 'seen')}, 0) ELSE 0 END"},
], {"volume_bucket_vpin": f"avg(v) {rows(50)}"}, prepare=_bucketed, more=REF_BARS.replace(
    "bars AS (SELECT b.*, r.ref FROM bars0 b JOIN refs r USING (ts))",
    "dv AS (SELECT symbol, avg(v) / 50 AS bucket FROM (SELECT symbol, CAST(ts AS DATE) AS d, sum(volume) AS v FROM bars0 GROUP BY 1, 2) GROUP BY 1), bars AS (SELECT b.*, dv.bucket FROM bars0 b JOIN dv USING (symbol))"))
_ind("kyle_lambda", "MS-3", "kyle_lambda", 20, [{"dl": f"close - {L('close')}", **_SV}], {"kyle_lambda": R2("regr_slope", "dl", "sv", 20)}, source="brand")
_ind("kyle_ratio", "MS-4", "kyle_ratio", 20, [{"a": D(f"abs({PCT('close')})", "volume")}], {"kyle_ratio": R("avg", "a", 20)}, source="brand")
_ind("amihud", "MS-5", "amihud", 20, [{"a": D(f"abs({PCT('close')})", "close * volume / 1000000.0")}], {"amihud": R("avg", "a", 20)}, source="brand")
_ind("roll_spread", "MS-6", "roll_spread", 20, [{"dl": f"close - {L('close')}"}, {"pd": L("dl")}, {"cv": R2("covar_samp", "dl", "pd", 19), "kn": f"count(dl) {rows(20)}"}],
     {"roll_spread": "CASE WHEN kn = 20 AND cv <= 0 THEN 2 * sqrt(-cv) END"}, 5, source="brand")
_ind("range_volatility", "MS-7", "range_volatility", 20, [
    {"lr": f"ln({D('close', L('close'))})", "hl2": "pow(ln(high / low), 2)", "co2": "pow(ln(close / open), 2)"}, {"gk": "0.5 * hl2 - (2 * ln(2) - 1) * co2"}],
    {"range_volatility_realized": f"{R('stddev_samp', 'lr', 20)} * sqrt(252)", "range_volatility_parkinson": f"sqrt(252 / (4 * ln(2)) * {R('avg', 'hl2', 20)})",
     "range_volatility_garman_klass": f"CASE WHEN {R('avg', 'gk', 20)} >= 0 THEN sqrt(252 * {R('avg', 'gk', 20)}) END"}, 5, source="brand")
_ind("volume_weighted_volatility", "MS-8", "volume_weighted_volatility", 20, [{"v": PCT("close") + " * volume"}, {"sq": f"pow(v - {R('avg', 'v', 20)}, 2)"}],
     {"volume_weighted_volatility": f"sqrt({R('avg', 'sq', 20)})"}, 4, source="brand")
_ind("tick_rule", "MS-9", "tick_rule", 20, [{"sg": f"nullif(sign(close - {L('close')}), 0)"}, {"fr": f"last_value(sg IGNORE NULLS) {running()}"}],
     {"tick_rule_rule": "CAST(fr AS DOUBLE)", "tick_rule_sum": f"CAST({R('sum', 'fr', 20)} AS DOUBLE)", "tick_rule_indicator": f"{R('sum', 'fr', 20)} / 20.0"}, source="brand")
_ind("efficiency_coefficient", "MS-10", "efficiency_coefficient", 20, [_RET], {"efficiency_coefficient": D(R("var_samp", "rt", 20), f"{R('var_samp', 'rt', 2)} * 20")}, 2, source="brand")
_ind("semi_volatility", "MS-11", "semi_volatility", 20, [_RET, {"ur": "CASE WHEN rt > 0 THEN rt WHEN rt IS NOT NULL THEN 0 END", "dr": "CASE WHEN rt < 0 THEN -rt WHEN rt IS NOT NULL THEN 0 END"}],
     {"semi_volatility_up": f"{R('stddev_samp', 'ur', 20)} * sqrt(252)", "semi_volatility_down": f"{R('stddev_samp', 'dr', 20)} * sqrt(252)",
      "semi_volatility_ratio": D(R("stddev_samp", "ur", 20), R("stddev_samp", "dr", 20))}, 5, source="brand")
_ind("reversals", "MS-12 MS-13", "reversals", 20, [
    {"sg": f"sign(close - {L('close')})"}, {"x": f"CASE WHEN sg IS NULL OR {L('sg')} IS NULL OR sg <> {L('sg')} THEN 1.0 ELSE 0.0 END"},
    {"isl": f"sum(x) {running()}"}, {"rl": "CASE WHEN sg IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY symbol, isl ORDER BY ts) AS DOUBLE) END"}],
    {"reversals_reversal": "CAST(x AS DOUBLE)", "reversals_freq": R("avg", "x", 20), "reversals_consec": R("avg", "rl", 20)}, source="brand")

# cross-asset
_ind("rolling_correlation", "XA-1 JN-16", "correlation", 20, [], {"correlation": R2("corr", "close", "ref", 20)}, prepare=_reference, more=REF_BARS)
_ind("relative_performance", "XA-2", "relative_performance", 1, [], {"relative_performance": D(D("close", f"first_value(close) {running()}"), D("ref", f"first_value(ref) {running()}"))}, 5,
     prepare=_reference, more=REF_BARS)
_ind("rolling_beta", "XA-3", "beta", 20, [{"a": PCT("close"), "b": PCT("ref")}], {"beta": R2("regr_slope", "a", "b", 20)}, 4, prepare=_reference, more=REF_BARS)

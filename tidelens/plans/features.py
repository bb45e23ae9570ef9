"""Feature queries: side-series features, calendar, lags, packs of indicators, user formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula
from ..functions.expr import json_num, rnd, rnd_up
from ..operators import features as X
from ..operators import registry
from ..sources import bars as B
from ..sources.tables import table
from .catalog import query
from .indicators import _GL, _K
from .sqlkit import BRAND_BARS, D, EVENT_BARS, L, OVER, PCT, R, R2, TR, ema, over_bars, ratio_index, recur, rows, running

_SIDE_SQL = BRAND_BARS.replace("bars AS (", "bars1 AS (") + """,
side AS (SELECT p_brand AS symbol, l_shipdate AS ts, CAST(count(*) AS DOUBLE) AS on_chain_transaction_count, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) + 1 AS on_chain_fee, avg(l_quantity) AS on_chain_hash_rate,
  sum(l_quantity) AS on_chain_exchange_inflow, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS on_chain_exchange_outflow, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) + 1 AS on_chain_active_addresses,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) + 0.01 AS sentiment_score, sum(l_quantity) / 10 AS sentiment_volume,
  avg(l_quantity) AS market_vix, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS market_usd, max(l_extendedprice) / 1000 AS market_sp500, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) + 0.01 AS market_treasury, min(l_extendedprice) / 1000 AS market_commodity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bars AS (SELECT * FROM bars1 JOIN side USING (symbol, ts))"""


def _with_sides(spark, root):
    li, part = table(spark, root, "lineitem"), table(spark, root, "part")
    money = lambda n: F.sum(F.col(n).cast("decimal(18,2)")).cast("double")
    n = F.count(F.lit(1))
    side = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("on_chain_transaction_count"), (money("l_tax") + 1).alias("on_chain_fee"),
        F.avg("l_quantity").alias("on_chain_hash_rate"), F.sum("l_quantity").alias("on_chain_exchange_inflow"),
        (money("l_extendedprice") / 1000).alias("on_chain_exchange_outflow"), (money("l_discount") + 1).alias("on_chain_active_addresses"),
        (money("l_discount") / n + 0.01).alias("sentiment_score"), (F.sum("l_quantity") / 10).alias("sentiment_volume"),
        F.avg("l_quantity").alias("market_vix"), (money("l_extendedprice") / n / 1000).alias("market_usd"), (F.max("l_extendedprice") / 1000).alias("market_sp500"),
        (money("l_tax") / n + 0.01).alias("market_treasury"), (F.min("l_extendedprice") / 1000).alias("market_commodity"))
    return B.numbered(B.brand_bars(spark, root).join(side, ["symbol", "ts"]), "1d")


def _run(spark, root, steps, history, outs, digits):
    x = X.apply_steps(_with_sides(spark, root), steps, history)
    cols = []
    for o in outs:
        cols.append(rnd_up(o, digits).alias(o) if x.schema[o].dataType.typeName() == "double" else F.col(o))
    return x.select("symbol", "ts", *cols)


def _zs(x, n):
    return D(f"{x} - {R('avg', x, n)}", R("stddev_samp", x, n))


_OC = ["on_chain_transaction_count", "on_chain_fee", "on_chain_hash_rate", "on_chain_exchange_inflow", "on_chain_exchange_outflow", "on_chain_active_addresses"]
_OC_OUT = {}
for _c in ("on_chain_fee", "on_chain_exchange_outflow"):
    _OC_OUT.update({f"{_c}_change_{k}d": PCT(_c, k) for k in (1, 7, 30)})
    _OC_OUT.update({f"{_c}_zscore_{n}": _zs(_c, n) for n in (20, 50, 200)})
    _OC_OUT.update({f"{_c}_price_corr_{n}": R2("corr", "close", _c, n) for n in (30, 90)})
_OC_OUT.update({
    "active_addr_momentum": D(PCT("on_chain_active_addresses", 7), PCT("on_chain_active_addresses", 30)),
    "tx_growth_rate": PCT("on_chain_transaction_count", 7), "tx_count_sma_7": R("avg", "on_chain_transaction_count", 7), "tx_count_sma_30": R("avg", "on_chain_transaction_count", 30),
    "fee_sma_7": R("avg", "on_chain_fee", 7), "fee_sma_30": R("avg", "on_chain_fee", 30), "fee_volatility": R("stddev_samp", "fch", 30),
    "hash_rate_growth": PCT("on_chain_hash_rate", 30), "exchange_net_flow": "on_chain_exchange_outflow - on_chain_exchange_inflow",
    "exchange_flow_ratio": D("on_chain_exchange_outflow", "on_chain_exchange_inflow"),
})


@query("on_chain_features", "FE-1", over_bars([{"fch": PCT("on_chain_fee")}], _OC_OUT, 5, _SIDE_SQL))
def on_chain_features(spark, root):
    steps, history = X.on_chain(_OC)
    return _run(spark, root, steps, history, list(_OC_OUT), 5)


_SE = {}
for _c in ("sentiment_score", "sentiment_volume"):
    _SE.update({f"{_c}_sma_{n}": R("avg", _c, n) for n in (3, 7, 14, 30)})
    _SE.update({f"{_c}_change_{k}d": PCT(_c, k) for k in (1, 7, 14)})
    _SE.update({f"{_c}_zscore_{n}": _zs(_c, n) for n in (30, 90)})
    _SE.update({f"{_c}_price_corr_{n}": R2("corr", "close", _c, n) for n in (14, 30, 60)})
    _SE.update({f"{_c}_momentum": f"({_c} - {L(_c, 3)}) / 3", f"{_c}_volatility": R("stddev_samp", _c, 14), f"{_c}_divergence": f"{_zs('close', 30)} - {_zs(_c, 30)}"})
_SE.update({"social_volume_price_ratio": D("sentiment_volume", "close"), "social_volume_norm": D("sentiment_volume", R("avg", "sentiment_volume", 30)),
            "sentiment_extreme": "CASE WHEN abs(z90) > 2 THEN CAST(sign(z90) AS DOUBLE) ELSE 0.0::DOUBLE END"})


@query("sentiment_features", "FE-2", over_bars([{"z90": _zs("sentiment_score", 90)}], _SE, 5, _SIDE_SQL))
def sentiment_features(spark, root):
    steps, history = X.sentiment(["sentiment_score", "sentiment_volume"])
    return _run(spark, root, steps, history, list(_SE), 5)


_MK = ["market_vix", "market_usd", "market_sp500", "market_treasury", "market_commodity"]
_GM = {}
for _c in ("market_vix", "market_sp500"):
    _GM.update({f"{_c}_return_1d": PCT(_c), f"{_c}_sma_50": R("avg", _c, 50), f"{_c}_sma_200": R("avg", _c, 200), f"{_c}_momentum": PCT(_c, 20),
                f"{_c}_volatility": f"{R('stddev_samp', 'r_' + _c, 20)} * sqrt(252)"})
    _GM.update({f"{_c}_price_corr_{n}": R2("corr", "pch", "r_" + _c, n) for n in (20, 60, 120)})
_GMI = {
    "high_vol_regime": f"CASE WHEN count(market_vix) {rows(252)} = 252 AND market_vix > quantile_cont(market_vix, 0.8) {rows(252)} THEN 1 ELSE 0 END",
    "usd_strength": f"CASE WHEN market_usd > {R('avg', 'market_usd', 50)} THEN 1 ELSE -1 END", "risk_regime_num": f"CASE WHEN market_sp500 > {R('avg', 'market_sp500', 200)} THEN 1 ELSE -1 END",
    "rate_regime_num": f"CASE WHEN market_treasury > {L('market_treasury', 20)} THEN 1 ELSE -1 END"}
_GMT = {"risk_regime": f"CASE WHEN market_sp500 > {R('avg', 'market_sp500', 200)} THEN 'risk_on' ELSE 'risk_off' END", "rate_regime": f"CASE WHEN market_treasury > {L('market_treasury', 20)} THEN 'rising' ELSE 'falling' END"}


@query("global_market_features", "FE-3", over_bars([{"pch": PCT("close"), "r_market_vix": PCT("market_vix"), "r_market_sp500": PCT("market_sp500")}], {**_GM, **_GMI, **_GMT}, 5, _SIDE_SQL, ints=tuple(_GMI), flags=tuple(_GMT)))
def global_market_features(spark, root):
    steps, history = X.global_market(_MK)
    return _run(spark, root, steps, history, [*_GM, *_GMI, *_GMT], 5)


@query("temporal_features", "FE-4 FN-3", """SELECT event_id, round(hour(ts) / 23.0, 6) AS hour_of_day, round((isodow(ts) - 1) / 6.0, 6) AS day_of_week, round(day(ts) / 31.0, 6) AS day_of_month, round(month(ts) / 12.0, 6) AS month_of_year,
 round(weekofyear(ts) / 53.0, 6) AS week_of_year, CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS sin_hour, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS cos_hour,
 round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS sin_day, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS cos_day, round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS sin_month, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS cos_month FROM events""")
def temporal_features(spark, root):
    return table(spark, root, "events").select("event_id", *[rnd(v).alias(k) for k, v in X.temporal().items()])


@query("lag_features", "FE-5 FE-7", over_bars([], {"close_lag_1": L("close"), "close_lag_5": L("close", 5), "volume_lag_3": L("volume", 3), "prev_close": L("close")}, 6, EVENT_BARS))
def lag_features(spark, root):
    s, h = X.lags({"close": [1, 5], "volume": [3]})
    p, _ = X.previous("close")
    x = X.apply_steps(B.numbered(B.event_bars(spark, root)), [{**s[0], **p[0]}], h)
    return x.select("symbol", "ts", *[rnd_up(c).alias(c) for c in ("close_lag_1", "close_lag_5", "volume_lag_3", "prev_close")])


@query("difference_features", "FE-6", over_bars([], {"close_diff_1": f"close - {L('close')}", "close_pct_5": PCT("close", 5), "volume_logdiff_2": f"ln(nullif({D('volume', L('volume', 2))}, 0))"}, 5, EVENT_BARS))
def difference_features(spark, root):
    s, h = X.differences({"close": [1, "pct_5"], "volume": ["log_2"]})
    x = X.apply_steps(B.numbered(B.event_bars(spark, root)), s, h)
    return x.select("symbol", "ts", *[rnd_up(c, 5).alias(c) for c in ("close_diff_1", "close_pct_5", "volume_logdiff_2")])


def _rounded(df, digits):
    return df.select(*[rnd_up(c, digits).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in df.columns])


@query("calculate_all", "FE-8 FE-9 UD-4")
def calculate_all(spark, root):
    return registry.calculate_all(B.numbered(B.event_bars(spark, root)))


def _filled(x):
    return f"coalesce(last_value({x} IGNORE NULLS) {running()}, 0)"


@query("selected_indicators", "FE-8 FE-9 UD-4", over_bars(
    [{"a": R("avg", "close", 14), "b": R("avg", "close", 50), "dl": f"close - {L('close')}"},
     {"g": "CASE WHEN dl > 0 THEN dl WHEN dl IS NOT NULL THEN 0 END", "ls": "CASE WHEN dl < 0 THEN -dl WHEN dl IS NOT NULL THEN 0 END", "ob": f"sum(coalesce(sign(dl) * volume, 0)) {running()}"},
     {"rs": ratio_index(R("avg", "g", 14), R("avg", "ls", 14)), "m": R("avg", "close", 14), "sd": R("stddev_samp", "close", 14)}, recur(ema("t.close", 20, "e"))],
    {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "sma_14": _filled("a"), "sma_50": _filled("b"), "rsi": _filled("rs"), "obv": "ob", "ema": "e",
     "bollinger_middle": _filled("m"), "bollinger_upper": _filled("(m + 2 * sd)"), "bollinger_lower": _filled("(m - 2 * sd)")}, 5, EVENT_BARS))
def selected_indicators(spark, root):
    x = registry.calculate_all(B.numbered(B.event_bars(spark, root)), ["sma", "rsi", "obv", "ema", "bollinger"], {"sma": [14, 50], "ema": [20]})
    return _rounded(x, 5)


@query("loader_pack", "FE-11", over_bars(
    [*_GL, {**_K, "tr": TR, "m": R("avg", "close", 20), "sd": R("stddev_samp", "close", 20)}, recur({**ema("t.close", 12, "f"), **ema("t.close", 26, "sl"), **ema("t.g", 0, "ge", 2, "(1.0/14)"), **ema("t.ls", 0, "le", 2, "(1.0/14)"), **ema("t.tr", 0, "ae", 1, "(1.0/14)")})],
    {**{f"sma_{n}": R("avg", "close", n) for n in (7, 25, 99)}, "ema_12": "f", "ema_26": "sl", "rsi": f"CASE WHEN rn > 14 THEN {ratio_index('ge', 'le')} END", "bb_middle": "m", "bb_upper": "m + 2 * sd", "bb_lower": "m - 2 * sd",
     "stoch_k": "k", "stoch_d": R("avg", "k", 3), "atr": "CASE WHEN rn >= 14 THEN ae END", "obv": f"sum(coalesce(sign(dl) * volume, 0)) {running()}"}, 5, EVENT_BARS))
def loader_pack(spark, root):
    wanted = {**{f"sma_{n}": ("sma", n) for n in (7, 25, 99)}, "ema_12": ("ema", 12), "ema_26": ("ema", 26), "rsi": ("rsi_wilder", 14), "bb": ("bollinger", 20),
              "stoch": ("stoch", 14), "atr": ("atr_wilder", 14), "obv": ("obv", 1)}
    return _rounded(registry.many(B.numbered(B.event_bars(spark, root)), wanted), 5)


@query("dataset_pack", "FE-12 FE-10", over_bars(
    [*_GL, {"tr": TR, "m": R("avg", "close", 20), "sd": R("stddev_samp", "close", 20)}, recur(ema("t.close", 12, "e"))],
    {"rsi_14": ratio_index(R("avg", "g", 14), R("avg", "ls", 14)), "sma_20": "m", "ema_12": "e", "bb_20_middle": "m", "bb_20_upper": "m + 2 * sd", "bb_20_lower": "m - 2 * sd", "atr_14": R("avg", "tr", 14)}, 5, EVENT_BARS))
def dataset_pack(spark, root):
    return _rounded(registry.by_names(B.numbered(B.event_bars(spark, root)), ["rsi_14", "sma_20", "ema_12", "bb_20", "atr_14", "unknown_3"]), 5)


@query("custom_features", "UD-1 UD-2 UD-3 FN-4", """WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_id, round((value + 2 * k) / (k + 1) + 1e-9, 6) AS blend, round(CASE WHEN value > 0 THEN ln(value) END + 1e-9, 6) AS log_value, round(sqrt(value) + 1e-9, 6) AS root, round(value * value + 1e-9, 4) AS square, round(value * value * value + 1e-9, 2) AS cube,
 CAST(sign(value - 40) AS DOUBLE) AS side, round(1 / (1 + exp(-value / 100)) + 1e-9, 6) AS squashed, round(tanh(value / 100) + 1e-9, 6) AS tanh, round(greatest(value, k) - least(value, k) + 1e-9, 6) AS gap FROM e""")
def custom_features(spark, root):
    e = table(spark, root, "events").select("event_id", "value", json_num("props", "$.k").alias("k"))
    e = e.withColumns({"centered": F.col("value") - 40, "small": F.col("value") / 100})
    cols = e.columns
    return e.select(
        "event_id", rnd_up(formula.arithmetic("(v + 2 * w) / (w + 1)", {"v": "value", "w": "k"}, cols)).alias("blend"), rnd_up(formula.named("log", "value")).alias("log_value"),
        rnd_up(formula.named("sqrt", "value")).alias("root"), rnd_up(formula.named("square", "value"), 4).alias("square"), rnd_up(formula.named("cube", "value"), 2).alias("cube"),
        formula.named("sign", "centered").alias("side"), rnd_up(formula.named("sigmoid", "small")).alias("squashed"), rnd_up(formula.named("tanh", "small")).alias("tanh"),
        rnd_up(formula.expression("greatest(value, k) - least(value, k)", cols)).alias("gap"))

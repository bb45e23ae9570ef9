"""Signal, market condition, and strategy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import json_num, rnd_up, rounded
from ..operators import signals as S
from ..sources import bars as B
from ..sources import domain as D
from ..sources.tables import table
from .catalog import query
from .evaluation import PRED, predictions
from .sqlkit import D as DIV, EVENT_BARS, L, PCT, R, TR, ema, over_bars, ratio_index, recur

_E = """e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p, (value - 40) / 1000 AS r, value AS u FROM events), x AS (SELECT *, least(greatest(u / (SELECT max(u) FROM e), 0), 1) AS nu,
 [p, (value % 10) / 10, 1 - p] AS m FROM e), y AS (SELECT *, list_reverse_sort(m) AS ms FROM x)"""
_CONF = {"binary": "abs(p - 0.5) * 2 * (1 - nu)", "probability": "p * (1 - nu)", "multi_class": "(ms[1] - ms[2]) * (1 - nu)", "regression": "1 - nu"}


def _raw(spark, root):
    p = json_num("props", "$.k") / 100
    e = table(spark, root, "events").select("event_id", "value", p.alias("p"), ((F.col("value") - 40) / 1000).alias("r"))
    return e.withColumn("m", F.array("p", F.col("value") % 10 / 10, 1 - F.col("p"))), e.agg(F.max("value")).scalar()


@query("signal_confidence", "SG-1", f"WITH {_E} SELECT event_id, " + ", ".join(f"round(1e-9 + least(greatest({v}, 0), 1), 6) AS {k}" for k, v in _CONF.items()) + " FROM y")
def signal_confidence(spark, root):
    e, top = _raw(spark, root)
    col = {"binary": "p", "probability": "p", "multi_class": "m", "regression": "r"}
    return e.select("event_id", *[rnd_up(S.confidence(k, c, F.col("value"), top)).alias(k) for k, c in col.items()])


_SIGS = {"binary": "CASE WHEN p > 0.5 THEN 1 WHEN p < 0.5 THEN -1 ELSE 0 END", "probability": "CASE WHEN p > 0.7 THEN 1 WHEN p < 0.3 THEN -1 ELSE 0 END",
         "multi_class": "CASE list_position(m, list_max(m)) - 1 WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END", "regression": "CASE WHEN r > 0.02 THEN 1 WHEN r < -0.01 THEN -1 ELSE 0 END"}


@query("trading_signals", "SG-2", f"WITH {_E} SELECT event_id, " + ", ".join(f"CAST(CASE WHEN least(greatest({_CONF[k]}, 0), 1) < 0.4 THEN 0 ELSE {v} END AS INTEGER) AS {k}" for k, v in _SIGS.items()) + " FROM y")
def trading_signals(spark, root):
    e, top = _raw(spark, root)
    col = {"binary": "p", "probability": "p", "multi_class": "m", "regression": "r"}
    return e.select("event_id", *[S.signal(k, c, S.confidence(k, c, F.col("value"), top), 0.4).alias(k) for k, c in col.items()])


@query("prediction_postprocess", "SG-3", """WITH e AS (SELECT event_id, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p, (event_id % 21 - 10) / 100.0 AS mag, (event_id % 7) / 100.0 AS vol FROM events),
s AS (SELECT *, CASE WHEN p > 0.6 THEN 'buy' WHEN p < 1 - 0.6 THEN 'sell' ELSE 'neutral' END AS sig, CASE WHEN p > 0.6 THEN p WHEN p < 1 - 0.6 THEN 1 - p ELSE 0.5 - abs(0.5 - p) END AS conf FROM e)
SELECT event_id, sig AS signal, round(1e-9 + conf, 6) AS confidence, CASE WHEN p > 0.5 THEN 'up' ELSE 'down' END AS expected_direction, round(1e-9 + close * mag, 6) + 0.0 AS expected_change, round(1e-9 + close * (1 + CASE WHEN p > 0.5 THEN 1 ELSE -1 END * abs(mag)), 6) AS target_price,
 round(1e-9 + close * (1 + mag + vol), 6) AS range_upper, round(1e-9 + close * (1 + mag - vol), 6) AS range_lower, CASE WHEN sig = 'buy' AND round(conf, 9) > 0.7 THEN 'strong_buy' WHEN sig = 'buy' THEN 'buy' WHEN sig = 'sell' AND round(conf, 9) > 0.7 THEN 'strong_sell' WHEN sig = 'sell' THEN 'sell' ELSE 'hold' END AS recommendation FROM s""")
def prediction_postprocess(spark, root):
    e = table(spark, root, "events").select("event_id", F.col("value").alias("close"), (json_num("props", "$.k") / 100).alias("direction"),
                                            ((F.col("event_id") % 21 - 10) / 100.0).alias("magnitude"), (F.col("event_id") % 7 / 100.0).alias("volatility"))
    out = S.postprocess(e)
    # 1 - 0.3 is a little above 0.7 in binary; both sides compare at nine digits
    sure = F.round("confidence", 9) > 0.7
    rec = F.when((F.col("signal") == "buy") & sure, "strong_buy").when((F.col("signal") == "sell") & sure, "strong_sell").when(F.col("signal") == "neutral", "hold").otherwise(F.col("signal"))
    nums = ["confidence", "expected_change", "target_price", "range_upper", "range_lower"]
    return out.select("event_id", "signal", "expected_direction", rec.alias("recommendation"), *[rnd_up(n).alias(n) for n in nums])


@query("ensemble_aggregation", "SG-4", f"""WITH {PRED}, m AS (SELECT symbol, ts, unnest([y_pred, prev, (y_pred + prev) / 2, y_pred * 0.9]) AS prediction, unnest([0.4, 0.3, 0.2, 0.1]) AS weight FROM pred)
SELECT symbol, ts, round(1e-9 + sum(prediction * weight) / sum(weight), 5) AS weighted, round(1e-9 + avg(prediction), 5) AS mean, round(1e-9 + stddev_pop(prediction), 5) AS std, round(1e-9 + list_sort(list(prediction))[2], 5) AS median FROM m GROUP BY 1, 2""")
def ensemble_aggregation(spark, root):
    p = predictions(spark, root)
    models = F.array(*[F.struct(F.lit(i).alias("model"), v.alias("prediction"), F.lit(w).alias("weight")) for i, (v, w) in enumerate(
        ((F.col("y_pred"), 0.4), (F.col("prev"), 0.3), ((F.col("y_pred") + F.col("prev")) / 2, 0.2), (F.col("y_pred") * 0.9, 0.1)))])
    out = S.ensemble(p.select("symbol", "ts", F.inline(models)), ["symbol", "ts"])
    return out.select("symbol", "ts", *[rnd_up(c, 5).alias(c) for c in ("weighted", "mean", "std", "median")])


_SIDE = "CASE WHEN close > {0} THEN 'bullish' WHEN close < {0} THEN 'bearish' WHEN close = {0} THEN 'neutral' END"
_MC_STEPS = [
    {"tr": TR, "dl": f"close - {L('close')}", "m50": R("avg", "close", 50), "m200": R("avg", "close", 200), "bm": R("avg", "close", 20), "bs": R("stddev_samp", "close", 20)},
    {"g": "CASE WHEN dl > 0 THEN dl WHEN dl IS NOT NULL THEN 0 END", "ls": "CASE WHEN dl < 0 THEN -dl WHEN dl IS NOT NULL THEN 0 END", "atrp": "100 * " + DIV(R("avg", "tr", 14), "close")},
    {"rsi0": ratio_index(R("avg", "g", 14), R("avg", "ls", 14))},
    recur({**ema("t.close", 12, "f"), **ema("t.close", 26, "sl")}),
    {"a": _SIDE.format("m50"), "b": _SIDE.format("m200"), "st": "CASE WHEN rsi0 > 70 THEN 'overbought' WHEN rsi0 < 30 THEN 'oversold' WHEN rsi0 IS NOT NULL THEN 'neutral' END", "up": "f - sl > 0", "bandw": DIV("4 * bs", "bm")},
    {"trend0": "CASE WHEN a = 'bullish' AND b = 'bullish' THEN 'bullish' WHEN a = 'bearish' AND b = 'bearish' THEN 'bearish' WHEN a = 'bullish' AND b = 'bearish' THEN 'cautiously_bullish' WHEN a = 'bearish' AND b = 'bullish' THEN 'cautiously_bearish' ELSE 'neutral' END",
     "mom0": "CASE WHEN st = 'overbought' AND up THEN 'strongly_bullish' WHEN st = 'oversold' AND NOT up THEN 'strongly_bearish' WHEN st = 'neutral' AND up THEN 'bullish' WHEN st = 'neutral' AND NOT up THEN 'bearish' WHEN st = 'overbought' THEN 'overbought' WHEN st = 'oversold' THEN 'oversold' ELSE 'neutral' END",
     "vol0": "CASE WHEN atrp > 3 THEN 'high' WHEN atrp > 1 THEN 'medium' WHEN atrp IS NOT NULL THEN 'low' ELSE 'normal' END || CASE WHEN bandw < 0.03 THEN '_contracting' WHEN bandw > 0.1 THEN '_expanding' ELSE '' END"},
    {"reg0": "CASE WHEN trend0 = 'bullish' AND vol0 <> 'high' THEN 'uptrend' WHEN trend0 = 'bearish' AND vol0 <> 'high' THEN 'downtrend' WHEN vol0 = 'high' THEN 'volatile' WHEN vol0 LIKE '%contracting' THEN 'consolidation' ELSE 'range_bound' END"},
]
_MC_OUT = {"close": "close", "rsi": "rsi0", "atr_pct": "atrp", "band": "bandw"}
_MC_FLAGS = {"trend": "trend0", "momentum": "mom0", "volatility": "vol0", "regime": "reg0"}


def _conditions(spark, root):
    return S.market_conditions(B.numbered(B.event_bars(spark, root)))


@query("market_conditions", "SG-5", over_bars(_MC_STEPS, {**_MC_OUT, **_MC_FLAGS}, 4, EVENT_BARS, flags=tuple(_MC_FLAGS)))
def market_conditions(spark, root):
    return _conditions(spark, root).select("symbol", "ts", *_MC_FLAGS, *[rnd_up(c, 4).alias(c) for c in _MC_OUT])


_PROF = "CASE reg0 WHEN 'uptrend' THEN 'moderate' WHEN 'range_bound' THEN 'moderate' WHEN 'volatile' THEN 'very_conservative' ELSE 'conservative' END"
_ST = {"profile": "prof", "direction": "CASE reg0 WHEN 'uptrend' THEN 'long' WHEN 'downtrend' THEN 'short' ELSE 'both' END", "trailing_stop": "reg0 IN ('uptrend', 'downtrend', 'volatile')"}
_STN = {"max_position": "CASE prof WHEN 'very_conservative' THEN 0.05 WHEN 'conservative' THEN 0.1 ELSE 0.15 END", "stop_loss": "sl0", "take_profit": "sl0 * CASE prof WHEN 'very_conservative' THEN 1.5 WHEN 'conservative' THEN 2.0 ELSE 2.5 END"}


@query("strategy_parameters", "SG-6 FLT-19", over_bars([*_MC_STEPS, {"prof": _PROF}, {"sl0": "CASE prof WHEN 'very_conservative' THEN 0.02 WHEN 'conservative' THEN 0.03 ELSE 0.05 END * CASE WHEN vol0 LIKE 'high%' THEN 1.5 WHEN vol0 LIKE 'low%' THEN 0.8 ELSE 1.0 END"}],
       {**_ST, **_STN}, 6, EVENT_BARS, flags=tuple(_ST)))
def strategy_parameters(spark, root):
    return S.strategy_parameters(_conditions(spark, root)).select("symbol", "ts", *_ST, *[rnd_up(c).alias(c) for c in _STN])


@query("windowed_inference", "SG-7", over_bars(_MC_STEPS, {"regime": "reg0", "trend": "trend0"}, 4, EVENT_BARS, flags=("regime", "trend"), tail="WHERE rn >= 100 AND (rn - 100) % 25 = 0"))
def windowed_inference(spark, root):
    return S.window_batches(_conditions(spark, root), 100, 25).select("symbol", "ts", "regime", "trend")


@query("drawdown_from_returns", "SG-11", f"""WITH {D.VALUES_SQL}, r AS (SELECT portfolio AS symbol, ts, (value - lag(value) OVER (PARTITION BY portfolio ORDER BY ts)) / lag(value) OVER (PARTITION BY portfolio ORDER BY ts) / 100 AS ret FROM pv),
g AS (SELECT symbol, ts, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS g FROM r)
SELECT symbol, ts, round(1 - g / max(g) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS drawdown FROM g""")
def drawdown_from_returns(spark, root):
    from ..operators.portfolio import cumulative_growth, drawdown, with_returns

    x = with_returns(D.portfolio_values(spark, root).withColumnRenamed("portfolio", "symbol")).withColumn("ret", F.col("ret") / 100)
    return rounded(drawdown(cumulative_growth(x, "ret"), "growth").select("symbol", "ts", "drawdown"), ["drawdown"])


@query("daily_trades", "SG-12", """WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, sum(CAST(value - 40 AS DECIMAL(18,2))) AS profit, count(*) AS trades FROM events GROUP BY 1, 2)
SELECT symbol, day, CAST(profit AS DOUBLE) AS profit, trades, CAST(sum(profit) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM d""")
def daily_trades(spark, root):
    t = table(spark, root, "events").select(F.col("event_type").alias("symbol"), "ts", (F.col("value") - 40).cast("decimal(18,2)").alias("profit"))
    return S.daily_trades(t).withColumns({"profit": F.col("profit").cast("double"), "running": F.col("running").cast("double")})


@query("state_volatility", "SG-13", f"WITH {EVENT_BARS}, r AS (SELECT *, {PCT('close')} AS rt FROM bars) SELECT symbol AS asset, ts, close AS price, round(1e-9 + {R('stddev_samp', 'rt', 24)}, 5) + 0.0 AS volatility FROM r")
def state_volatility(spark, root):
    st = B.event_bars(spark, root).select("ts", F.col("symbol").alias("asset"), F.col("close").alias("price"))
    return S.state_volatility(st).select("asset", "ts", "price", rnd_up("volatility", 5).alias("volatility"))

"""Portfolio and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import div, rnd, rounded
from ..operators import portfolio as P
from ..sources import bars as B
from ..sources import domain as D
from ..sources.tables import table
from .catalog import query
from .sqlkit import EVENT_BARS

_RET = f"""{D.VALUES_SQL},
rt AS (SELECT portfolio AS symbol, ts, value, CASE WHEN pvv > 0 THEN (value - pvv) / pvv ELSE 0 END AS ret FROM (SELECT *, lag(value) OVER (PARTITION BY portfolio ORDER BY ts) AS pvv FROM pv)),
mr AS (SELECT ts, CASE WHEN pm > 0 THEN (market - pm) / pm ELSE 0 END AS market_ret FROM (SELECT *, lag(market) OVER (ORDER BY ts) AS pm FROM mv))"""


def _values(spark, root):
    return D.portfolio_values(spark, root).withColumnRenamed("portfolio", "symbol")


def _returns(spark, root):
    return P.with_returns(_values(spark, root))


def _market(spark, root):
    return P.market_returns(D.market_values(spark, root))


@query("portfolio_returns", "PF-1", f"WITH {_RET} SELECT symbol, ts, value, round(ret, 6) + 0.0 AS ret FROM rt")
def portfolio_returns(spark, root):
    return rounded(_returns(spark, root).drop("_rn"), ["ret"])


_DD = "dd AS (SELECT symbol, ts, value, ret, 1 - value / max(value) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drawdown FROM rt)"


@query("portfolio_analytics", "PF-2 PF-3 PF-4 PF-5 PF-6 PF-8 JN-12", f"""WITH {_RET}, {_DD}
SELECT symbol, arg_max(value, ts) AS total_value, round(avg(ret) / stddev_samp(ret), 6) AS sharpe_ratio, round(stddev_samp(ret), 6) AS volatility, round(max(drawdown), 6) AS max_drawdown,
 round(regr_slope(ret, market_ret), 6) AS beta, round(regr_intercept(ret, market_ret), 6) AS alpha, count(*) AS points,
 round(arg_max(value, ts) - arg_min(value, ts), 4) AS total_return, round((arg_max(value, ts) - arg_min(value, ts)) / arg_min(value, ts) * 100, 5) AS total_return_pct
FROM dd LEFT JOIN mr USING (ts) GROUP BY 1""")
def portfolio_analytics(spark, root):
    out = P.summary(_returns(spark, root), _market(spark, root))
    out = rounded(out, ["sharpe_ratio", "volatility", "max_drawdown", "beta", "alpha"])
    return rounded(rounded(out, ["total_return"], 4), ["total_return_pct"], 5)


@query("value_at_risk", "PF-7", f"""WITH {_RET}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rt)
SELECT symbol, round(abs(max(ret) FILTER (i = floor(n * 0.05))), 6) AS var_95, round(abs(max(ret) FILTER (i = floor(n * 0.01))), 6) AS var_99,
 round(abs(coalesce(avg(ret) FILTER (i < floor(n * 0.05)), 0)), 6) AS expected_shortfall FROM k GROUP BY 1""")
def value_at_risk(spark, root):
    return rounded(P.value_at_risk(_returns(spark, root)), ["var_95", "var_99", "expected_shortfall"])


@query("risk_record", "PF-9 PF-10", f"""WITH {_RET}, {_DD}, {D.ALLOCATIONS_SQL},
k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rt),
v AS (SELECT symbol, round(abs(max(ret) FILTER (i = floor(n * 0.05))), 6) AS var_95, round(abs(coalesce(avg(ret) FILTER (i < floor(n * 0.05)), 0)), 6) AS expected_shortfall FROM k GROUP BY 1),
b AS (SELECT symbol, round(max(drawdown), 6) AS max_drawdown, round(regr_slope(ret, market_ret), 6) AS beta FROM dd LEFT JOIN mr USING (ts) GROUP BY 1)
SELECT symbol, var_95, expected_shortfall, max_drawdown, beta, round(h, 6) AS concentration FROM v JOIN b USING (symbol) JOIN (SELECT portfolio AS symbol, sum(weight * weight) AS h FROM al GROUP BY 1) USING (symbol)""")
def risk_record(spark, root):
    r = _returns(spark, root)
    v = P.value_at_risk(r).select("symbol", rnd("var_95").alias("var_95"), rnd("expected_shortfall").alias("expected_shortfall"))
    s = P.summary(r, _market(spark, root)).select("symbol", rnd("max_drawdown").alias("max_drawdown"), rnd("beta").alias("beta"))
    c = P.concentration(D.allocations(spark, root)).select(F.col("portfolio").alias("symbol"), rnd("hhi").alias("concentration"))
    return v.join(s, "symbol").join(c, "symbol")


@query("concentration", "PF-10", f"WITH {D.ALLOCATIONS_SQL} SELECT portfolio, round(sum(weight * weight), 6) AS hhi, round(1 - sum(weight * weight), 6) AS diversification, round(max(weight), 6) AS max_weight FROM al GROUP BY 1")
def concentration(spark, root):
    return rounded(P.concentration(D.allocations(spark, root)), ["hhi", "diversification", "max_weight"])


_BENCH = f"""{_RET}, {_DD}, bn AS (SELECT 'market' AS benchmark, ts, market_ret AS bench_ret FROM mr UNION ALL SELECT 'portfolio_0', ts, ret FROM rt WHERE symbol = 0),
q AS (SELECT symbol, quantile_cont(ret, 0.05) AS p05, quantile_cont(ret, 0.95) AS p95 FROM rt GROUP BY 1),
cv AS (SELECT rt.symbol, avg(ret) AS cvar_95 FROM rt JOIN q USING (symbol) WHERE ret <= p05 GROUP BY 1),
a AS (SELECT symbol, benchmark, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dsd, max(drawdown) AS mdd, coalesce(regr_slope(ret, bench_ret), 0) AS beta,
  avg(bench_ret) AS bm, avg(ret - bench_ret) / nullif(stddev_samp(ret - bench_ret), 0) AS ir, skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS sk, kurtosis_pop(ret) AS ku
  FROM dd JOIN bn USING (ts) GROUP BY 1, 2)"""


@query("performance_record", "PF-25 PF-26", f"""WITH {_BENCH} SELECT symbol, benchmark, n, round(mean * 252, 5) AS annualized_return, round(sd * sqrt(252), 5) AS annualized_volatility, round(mean / sd, 5) AS sharpe_ratio,
 round(mean / dsd, 5) AS sortino_ratio, round(mean * 252 / mdd, 5) AS calmar_ratio, round(mdd, 5) AS max_drawdown, round(beta, 5) AS beta, round(mean - beta * bm, 5) + 0.0 AS alpha, round(ir, 5) AS information_ratio,
 round(p95 / abs(p05), 5) AS tail_ratio, round(sk, 5) AS skewness, round(ku, 4) AS kurtosis, round(cvar_95, 5) AS cvar_95, round(dsd, 5) AS downside_deviation FROM a JOIN q USING (symbol) JOIN cv USING (symbol)""")
def performance_record(spark, root):
    r = _returns(spark, root)
    bench = _market(spark, root).select(F.lit("market").alias("benchmark"), "ts", F.col("market_ret").alias("bench_ret"))
    bench = bench.unionByName(r.filter("symbol = 0").select(F.lit("portfolio_0").alias("benchmark"), "ts", F.col("ret").alias("bench_ret")))
    out = P.performance_record(r, bench)
    return rounded(rounded(out, [c for c in out.columns if c not in ("symbol", "benchmark", "n", "kurtosis")], 5), ["kurtosis"], 4)


@query("monthly_performance", "AG-32 FN-3", f"""WITH {_RET} SELECT symbol, strftime(ts, '%Y-%m') AS period, round(exp(sum(ln(1 + ret))) - 1, 5) + 0.0 AS period_return, round(stddev_samp(ret), 6) AS volatility,
 round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0), 6) AS sharpe_ratio, count(*) AS points FROM rt GROUP BY 1, 2""")
def monthly_performance(spark, root):
    return rounded(rounded(P.periodic_performance(_returns(spark, root)), ["volatility", "sharpe_ratio"]), ["period_return"], 5)


@query("vault_analytics", "PF-27", f"""WITH {_RET}, b AS (SELECT symbol, ts, sum(value) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM rt)
SELECT symbol, date_trunc('month', ts) AS month, round(arg_max(balance, ts), 2) AS balance FROM b GROUP BY 1, 2""")
def vault_analytics(spark, root):
    from ..operators.series import number_rows, prefix

    b = prefix(number_rows(_values(spark, root)), {"balance": ("sum", F.col("value"))})
    return b.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(rnd(F.max_by("balance", "ts"), 2).alias("balance"))


_ANALYSIS = """now AS (SELECT max(ts) AS now FROM rr), dd AS (SELECT symbol, max((peak - value) / nullif(peak, 0)) AS dd FROM (SELECT *, max(value) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM rr) GROUP BY 1),
g AS (SELECT symbol, arg_max(value, ts) AS v, arg_min(value, ts) AS f, arg_max(value, ts) FILTER (ts <= now - INTERVAL 30 DAY) AS m, arg_max(value, ts) FILTER (ts <= now - INTERVAL 90 DAY) AS q, arg_max(value, ts) FILTER (ts <= now - INTERVAL 365 DAY) AS y,
 stddev_samp(ret) FILTER (rn > 1) AS vol, sqrt(avg(least(ret, 0) * least(ret, 0)) FILTER (rn > 1)) AS down, avg(ret) FILTER (rn > 1) AS mean FROM rr, now GROUP BY 1)
SELECT symbol, round((v - m) / nullif(m, 0), 5) AS monthly, round((v - q) / nullif(q, 0), 5) AS quarterly, round((v - y) / nullif(y, 0), 5) AS yearly, round(coalesce((v - f) / nullif(f, 0) / nullif(vol, 0), 0), 5) AS risk_adjusted, round(vol, 5) AS volatility,
 round(-dd, 5) AS max_drawdown, round(down, 5) AS downside_deviation, round(coalesce(mean / nullif(down, 0), 0), 5) AS sortino_ratio, round(coalesce((v - y) / nullif(y, 0) / nullif(dd, 0), 0), 5) AS calmar_ratio FROM g JOIN dd USING (symbol)"""
_NUMBERS = ["monthly", "quarterly", "yearly", "risk_adjusted", "volatility", "max_drawdown", "downside_deviation", "sortino_ratio", "calmar_ratio"]
_RR = "rr AS (SELECT symbol, ts, value, coalesce(CASE WHEN prev > 0 THEN (value - prev) / prev ELSE 0 END, 0) AS ret, rn FROM (SELECT portfolio AS symbol, ts, value, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM pv{} WINDOW w AS (PARTITION BY portfolio ORDER BY ts)))"


@query("vault_return_analysis", "PF-27", f"WITH {D.VALUES_SQL}, {_RR.format('')}, {_ANALYSIS}")
def vault_return_analysis(spark, root):
    return rounded(P.return_analysis(_values(spark, root)), _NUMBERS, 5)


@query("vault_return_analysis_range", "PF-27 FLT-6", f"WITH {D.VALUES_SQL}, {_RR.format(" WHERE ts BETWEEN '1995-06-01' AND '1998-03-31'")}, {_ANALYSIS}")
def vault_return_analysis_range(spark, root):
    return rounded(P.return_analysis(_values(spark, root), "1995-06-01", "1998-03-31"), _NUMBERS, 5)


@query("vault_asset_correlation", "PF-27", f"""WITH {D.VALUES_SQL}, {_RR.format('')},
ap AS (SELECT 'a' || (l_partkey % 10) AS symbol, o_orderdate AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
ar AS (SELECT symbol, ts, CASE WHEN prev > 0 THEN (value - prev) / prev ELSE 0 END AS ret FROM (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM ap WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE rn > 1)
SELECT rr.symbol, ar.symbol AS asset, count(*) AS points, round(coalesce(corr(rr.ret, ar.ret), 0), 5) + 0.0 AS correlation FROM rr JOIN ar ON rr.ts = ar.ts WHERE rn > 1 GROUP BY 1, 2 HAVING count(*) >= 10""")
def vault_asset_correlation(spark, root):
    li, od = table(spark, root, "lineitem"), table(spark, root, "orders")
    prices = li.join(od, li.l_orderkey == od.o_orderkey).groupBy(F.concat(F.lit("a"), F.col("l_partkey") % 10).alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return rounded(P.asset_correlations(P.with_returns(_values(spark, root)), P.with_returns(prices)), ["correlation"], 5)


# market states: hourly bars with derived volatility, liquidity and sentiment
_STATES = EVENT_BARS + """,
st AS (SELECT ts, symbol AS asset, close AS price, volume, (high - low) / (high + low) AS volatility, volume / (volume + 50) AS liquidity, least(volume / 200, 1.0) AS sentiment FROM bars)"""


def _states(spark, root):
    b = B.event_bars(spark, root)
    return b.select("ts", F.col("symbol").alias("asset"), F.col("close").alias("price"), "volume",
                    div(F.col("high") - F.col("low"), F.col("high") + F.col("low")).alias("volatility"),
                    div("volume", F.col("volume") + 50.0).alias("liquidity"), F.least(F.col("volume") / 200.0, F.lit(1.0)).alias("sentiment"))


_PAIRS = "pr AS (SELECT a.ts, avg(least(a.price, b.price) / greatest(a.price, b.price)) AS pair_ratio FROM st a JOIN st b ON a.ts = b.ts AND a.asset < b.asset GROUP BY 1)"
_SRISK = f"""{_PAIRS}, g AS (SELECT ts, avg(volatility) AS vol, quantile_cont(price * volume, 0.05) AS p5, avg(price * volume) AS mw, avg(liquidity) AS liq FROM st GROUP BY 1),
sr AS (SELECT ts, coalesce(pair_ratio, 0) AS pair_ratio, coalesce(abs(p5) / nullif(mw, 0), 0) AS var_share, least(greatest(0.3 * vol + 0.3 * coalesce(abs(p5) / nullif(mw, 0), 0) + 0.2 * coalesce(pair_ratio, 0) + 0.2 * (1 - liq), 0), 1) AS risk_score FROM g LEFT JOIN pr USING (ts))"""


@query("state_risk", "PF-12 PF-13", f"WITH {_STATES}, {_SRISK} SELECT ts, round(pair_ratio, 6) AS pair_ratio, round(var_share, 6) AS var_share, round(risk_score, 6) AS risk_score FROM sr")
def state_risk(spark, root):
    return rounded(P.state_risk(_states(spark, root)), ["pair_ratio", "var_share", "risk_score"])


@query("score_allocation", "PF-14 FN-7", f"""WITH {_STATES}, {_SRISK}, a AS (SELECT ts, asset, least(greatest(sentiment * (1 - risk_score), 0), 0.2) AS a FROM st JOIN sr USING (ts)), t AS (SELECT *, sum(a) OVER (PARTITION BY ts) AS t FROM a)
SELECT ts, asset, round(CASE WHEN t > 0 THEN a / t ELSE a END, 6) AS weight FROM t""")
def score_allocation(spark, root):
    s = _states(spark, root)
    x = s.select("ts", "asset", F.col("sentiment").alias("score")).join(P.state_risk(s).select("ts", "risk_score"), "ts")
    return rounded(P.allocate_from_scores(x), ["weight"])


_TILT = f"""{D.ALLOCATIONS_SQL}, ti AS (SELECT portfolio, asset, weight * pow(0.5, CAST(substr(asset, 2) AS INTEGER) * (1 + portfolio % 3)) AS weight FROM al)"""


def _tilted(spark, root):
    al = D.allocations(spark, root)
    digit = F.substring("asset", 2, 3).cast("int")
    return al.withColumn("weight", F.col("weight") * F.pow(F.lit(0.5), digit * (1 + F.col("portfolio") % 3)))


@query("limit_allocations", "PF-15", f"""WITH {_TILT}, w1 AS (SELECT portfolio, asset, count(*) OVER p AS n, CASE WHEN abs(sum(weight) OVER p - 1) > 0.01 THEN weight / sum(weight) OVER p ELSE weight END AS w FROM ti WINDOW p AS (PARTITION BY portfolio)),
w2 AS (SELECT *, greatest(w - 0.2, 0) AS x FROM w1), w3 AS (SELECT portfolio, asset, n, (least(w, 0.2) + (sum(x) OVER (PARTITION BY portfolio) - x) / (n - 1)) * least((portfolio % 10) / 10.0 / 0.6, 1.0) AS w FROM w2),
w4 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY portfolio ORDER BY w DESC, asset) = 1 AND w > 0.5 THEN (w - 0.5) * 0.5 ELSE 0 END AS cut FROM w3)
SELECT portfolio, asset, round(sum(w), 6) + 0.0 AS weight FROM (SELECT portfolio, asset, w - cut AS w FROM w4 UNION ALL SELECT portfolio, 'USDC', cut FROM w4 WHERE cut > 0) GROUP BY 1, 2""")
def limit_allocations(spark, root):
    return rounded(P.limit_allocations(_tilted(spark, root), (F.col("portfolio") % 10) / 10.0), ["weight"])


@query("fallback_allocation", "PF-31", f"""WITH {_TILT}, n AS (SELECT portfolio, asset, weight / sum(weight) OVER (PARTITION BY portfolio) AS weight FROM ti), c AS (SELECT portfolio, asset, least(weight, 0.2) AS weight FROM n)
SELECT portfolio, asset, round(weight, 6) AS weight FROM c UNION ALL SELECT portfolio, 'USDC', round(1 - sum(weight), 6) FROM c GROUP BY 1 HAVING 1 - sum(weight) > 0""")
def fallback_allocation(spark, root):
    from pyspark.sql import Window

    t = _tilted(spark, root)
    t = t.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("portfolio")))
    return rounded(P.fallback_allocation(t), ["weight"])


_SENT = f"""{D.POSTS_SQL}, se AS (SELECT 'a' || substr(protocol, 2) AS asset, sum(sentiment * confidence) / sum(confidence) AS score, avg(confidence) AS confidence, count(*) FILTER (sentiment < -0.5) AS neg FROM pp GROUP BY 1)"""


def _asset_sentiment(spark, root):
    p = D.posts(spark, root).select("post_id", "sentiment", "confidence", F.explode("protocols").alias("protocol"))
    return p.groupBy(F.concat(F.lit("a"), F.substring("protocol", 2, 3)).alias("asset")).agg(
        div(F.sum(F.col("sentiment") * F.col("confidence")), F.sum("confidence")).alias("score"), F.avg("confidence").alias("confidence"),
        F.count_if(F.col("sentiment") < -0.5).alias("neg"))


@query("sentiment_adjustment", "PF-16 JN-15", f"""WITH {_SENT}, {D.ALLOCATIONS_SQL}, a AS (SELECT portfolio, asset, weight * coalesce(1 + score * confidence * 0.15, 1) AS a FROM al LEFT JOIN se USING (asset))
SELECT portfolio, asset, round(a / sum(a) OVER (PARTITION BY portfolio), 6) AS weight FROM a""")
def sentiment_adjustment(spark, root):
    s = _asset_sentiment(spark, root).select("asset", "score", "confidence")
    return rounded(P.adjust_by_sentiment(D.allocations(spark, root), s), ["weight"])


_AST = "ast AS (SELECT 'a' || CAST(row_number() OVER (ORDER BY symbol) - 1 AS VARCHAR) AS asset, v, l, p, q FROM (SELECT symbol, avg((high - low) / (high + low)) AS v, avg(volume / (volume + 50)) AS l, arg_max(close, ts) AS p, avg(close) AS q FROM bars GROUP BY 1))"


def _asset_states(spark, root):
    """Five assets a0..a4 from the event types in name order."""
    names = {"click": "a0", "error": "a1", "purchase": "a2", "signup": "a3", "view": "a4"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    b = B.event_bars(spark, root)
    return b.groupBy(F.element_at(m, F.col("symbol")).alias("asset")).agg(
        F.avg(div(F.col("high") - F.col("low"), F.col("high") + F.col("low"))).alias("volatility"),
        F.avg(div("volume", F.col("volume") + 50.0)).alias("liquidity"), F.max_by("close", "ts").alias("price"), F.avg("close").alias("predicted"))


@query("weighted_risk", "PF-11", f"""WITH {EVENT_BARS}, {_AST}, {_SENT}, {D.ALLOCATIONS_SQL}, j AS (SELECT portfolio, weight, coalesce(v, 0.02) AS v, coalesce(l, 1.0) AS l, coalesce(neg % 4, 0) AS s FROM al LEFT JOIN ast USING (asset) LEFT JOIN se USING (asset)),
r AS (SELECT portfolio, sum(weight * weight) AS c, sum(weight * v) AS v, sum(weight * (1 - l)) AS l, least(sum(s * 0.1), 1.0) AS s FROM j GROUP BY 1)
SELECT portfolio, round(c, 6) AS concentration_risk, round(v, 6) AS volatility_risk, round(l, 6) AS liquidity_risk, CAST(s AS DOUBLE) AS sentiment_risk, round(0.3 * c + 0.35 * v + 0.25 * l + 0.1 * s, 6) AS overall_risk FROM r""")
def weighted_risk(spark, root):
    st = _asset_states(spark, root).select("asset", "volatility", "liquidity")
    sg = _asset_sentiment(spark, root).select("asset", (F.col("neg") % 4).alias("risk_signals"))
    out = P.weighted_risk(D.allocations(spark, root), st, sg)
    return rounded(out, ["concentration_risk", "volatility_risk", "liquidity_risk", "overall_risk"]).withColumn("sentiment_risk", rnd("sentiment_risk"))


@query("expected_return", "PF-22", f"""WITH {EVENT_BARS}, {_AST}, {D.ALLOCATIONS_SQL} SELECT portfolio, round(sum(weight * coalesce((q - p) / p, 0)) * (1 - 0.4 * 0.5), 6) + 0.0 AS expected_return,
 round(least(max(v) + 2 * max(weight) + 0.5 * 0.4, 0.5), 6) AS drawdown_full, round(least(0.5 * max(weight) + 0.3 * 0.4, 0.5), 6) AS drawdown_short, round(sum(CASE WHEN p IS NULL THEN weight ELSE 0 END), 6) AS unpriced FROM al LEFT JOIN ast USING (asset) GROUP BY 1""")
def expected_return(spark, root):
    pr = _asset_states(spark, root).withColumn("risk", F.lit(0.4))
    return rounded(P.expected_return(D.allocations(spark, root), pr), ["expected_return", "drawdown_full", "drawdown_short", "unpriced"])


@query("rebalance_trigger", "PF-18 FLT-21", f"""WITH {_STATES}, g AS (SELECT ts, avg(volatility) AS volatility, date_diff('hour', lag(ts) OVER (ORDER BY ts), ts) AS h, avg(sentiment) AS confidence FROM st GROUP BY 1)
SELECT ts, coalesce(h, 0) >= 2 OR volatility > 0.5 OR confidence < 0.2 AS rebalance FROM g""")
def rebalance_trigger(spark, root):
    g = _states(spark, root).groupBy("ts").agg(F.avg("volatility").alias("volatility"), F.avg("sentiment").alias("confidence"))
    from ..functions.rolling import lag
    from ..operators.series import blocks, number_rows, unblock

    x = unblock(blocks(number_rows(g.withColumn("symbol", F.lit("state"))), 1).withColumn(
        "hours_since", F.coalesce((F.unix_timestamp("ts") - F.unix_timestamp(lag("ts"))) / 3600.0, F.lit(0.0))))
    x = x.withColumn("drift", F.lit(None).cast("double"))
    return P.rebalance_trigger(x, max_hours=2.0, max_volatility=0.5, min_confidence=0.2).select("ts", "rebalance")


@query("state_alerts", "PF-19 SM-10", f"""WITH {_STATES}, {_SRISK}, g2 AS (SELECT ts, avg(volatility) AS volatility, avg(sentiment) AS confidence, max(liquidity) AS max_weight FROM st GROUP BY 1), j AS (SELECT g2.*, risk_score FROM g2 JOIN sr USING (ts))
SELECT ts, 'high_volatility' AS type, 'warning' AS severity, round(volatility, 6) AS value FROM j WHERE volatility > 0.1 UNION ALL SELECT ts, 'low_confidence', 'warning', round(confidence, 6) FROM j WHERE confidence < 0.5
UNION ALL SELECT ts, 'high_risk', 'danger', round(risk_score, 6) FROM j WHERE risk_score > 0.8 UNION ALL SELECT ts, 'high_concentration', 'warning', round(max_weight, 6) FROM j WHERE max_weight > 0.5""")
def state_alerts(spark, root):
    s = _states(spark, root)
    g = s.groupBy("ts").agg(F.avg("volatility").alias("volatility"), F.avg("sentiment").alias("confidence"), F.max("liquidity").alias("max_weight"))
    return rounded(P.state_alerts(g.join(P.state_risk(s).select("ts", "risk_score"), "ts"), "ts"), ["value"])


@query("market_regime", "PF-21", f"""WITH {_STATES}, g AS (SELECT ts, avg(volatility / 10) AS volatility, avg(sentiment) AS sentiment, avg(volume) AS volume, quantile_cont(volume, 0.25) AS q FROM st GROUP BY 1)
SELECT ts, CASE WHEN volatility > 0.05 AND sentiment < 0.3 THEN 'BEAR_MARKET' WHEN volatility < 0.02 AND sentiment > 0.7 THEN 'BULL_MARKET' WHEN volatility > 0.04 THEN 'HIGH_VOLATILITY' WHEN volume < q THEN 'LOW_LIQUIDITY' ELSE 'RANGING_MARKET' END AS regime,
 round(volatility, 6) AS volatility, round(sentiment, 6) AS sentiment, round(volume, 6) AS volume FROM g""")
def market_regime(spark, root):
    s = _states(spark, root).withColumn("volatility", F.col("volatility") / 10)
    return rounded(P.regime(s), ["volatility", "sentiment", "volume"])


@query("key_drivers", "PF-20", f"""WITH {_STATES} SELECT ts, CASE WHEN max(volume) > 1.5 * avg(volume) THEN arg_max(asset, (volume, asset)) END AS volume_driver, round(CASE WHEN max(volume) > 1.5 * avg(volume) THEN max(volume) / avg(volume) END, 6) AS volume_ratio,
 count(*) FILTER (sentiment > 0.8 OR sentiment < 0.2) AS extreme_sentiments FROM st GROUP BY 1""")
def key_drivers(spark, root):
    return rounded(P.key_drivers(_states(spark, root)), ["volume_ratio"])


@query("trade_risk", "PF-23", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS amount, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'A' THEN 'sell' ELSE 'buy' END AS direction, l_suppkey % 7 AS risk_level, o_totalprice / 5000 AS pv FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT *, CASE risk_level WHEN 1 THEN 0.02 WHEN 2 THEN 0.03 WHEN 3 THEN 0.05 WHEN 4 THEN 0.07 WHEN 5 THEN 0.1 ELSE 0.05 END AS st, CASE WHEN direction = 'buy' THEN 1 ELSE -1 END AS sd FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, direction, round(1e-9 + amount * price, 6) AS trade_value, round(1e-9 + price * (1 - sd * st), 6) AS stop_loss_price, round(1e-9 + price * (1 + sd * st * 2.5), 6) AS take_profit_price, round(1e-9 + amount * st, 6) AS max_loss,
 round(1e-9 + amount * st / pv * 100, 6) AS portfolio_risk_pct, CASE WHEN amount * st / pv < 0.02 THEN 'acceptable' ELSE 'high' END AS assessment, round(1e-9 + CASE WHEN amount * st / pv > 0.02 THEN 0.02 * pv / st ELSE amount END, 6) AS adjusted_amount FROM s""")
def trade_risk(spark, root):
    li, od = table(spark, root, "lineitem"), table(spark, root, "orders")
    t = li.join(od, li.l_orderkey == od.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("amount"), div("l_extendedprice", "l_quantity").alias("price"),
        F.when(F.col("l_returnflag") == "A", "sell").otherwise("buy").alias("direction"), (F.col("l_suppkey") % 7).alias("risk_level"),
        (F.col("o_totalprice") / 5000).alias("portfolio_value"))
    out = P.trade_risk(t).drop("amount", "price", "risk_level", "portfolio_value")
    money = ["trade_value", "stop_loss_price", "take_profit_price", "adjusted_amount", "max_loss", "portfolio_risk_pct"]
    # the nudge keeps exact decimal ties from falling on either side
    return out.select(*[rnd(F.col(n) + 1e-9).alias(n) if n in money else F.col(n) for n in out.columns])

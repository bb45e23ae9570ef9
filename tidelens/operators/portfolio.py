"""Portfolio returns, risk and allocation operators.

Value series use the blocked series kernel, so one very long portfolio is spread over
tasks. Allocation operators work on long rows (portfolio, asset, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, div
from ..functions.rolling import lag
from .quantile import exact_quantiles
from .series import blocks, number_rows, prefix, unblock


def with_returns(values: DataFrame) -> DataFrame:
    """(symbol, ts, value) -> adds ``_rn`` and ``ret``: first 0, 0 after a non-positive value."""
    x = blocks(number_rows(values), 1)
    prev = lag("value")
    ret = F.when(prev > 0, (F.col("value") - prev) / prev).otherwise(0.0)
    return unblock(x.withColumn("ret", ret))


def drawdown(series: DataFrame, value: str, out: str = "drawdown", keys=("symbol",)) -> DataFrame:
    """Adds the running peak share lost so far; needs ``_rn``."""
    x = prefix(series, {"_peak": ("max", F.col(value))}, keys)
    return x.withColumn(out, div(F.col("_peak") - F.col(value), "_peak")).drop("_peak")


def cumulative_growth(series: DataFrame, ret: str, out: str = "growth", keys=("symbol",)) -> DataFrame:
    """Running product of (1 + return), as the exponential of a running log sum.

    Factors at or below zero cannot go through a logarithm: their sign is carried as a
    running count and a zero factor as a running flag.
    """
    f = 1.0 + F.coalesce(F.col(ret), F.lit(0.0))
    x = prefix(series, {
        "_ls": ("sum", F.when(f != 0, F.log(F.abs(f))).otherwise(0.0)),
        "_ng": ("sum", F.when(f < 0, 1).otherwise(0)),
        "_zr": ("sum", F.when(f == 0, 1).otherwise(0)),
    }, keys)
    sign = F.when(F.col("_ng") % 2 == 1, -1.0).otherwise(1.0)
    return x.withColumn(out, F.when(F.col("_zr") > 0, 0.0).otherwise(sign * F.exp("_ls"))).drop("_ls", "_ng", "_zr")


SPANS = {"monthly": 30, "quarterly": 90, "yearly": 365}  # days of the return periods (fixed values)


def return_analysis(values: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Returns by period and risk of each vault's value series (symbol, ts, value), inside a range of dates if given.

    A period's return is the newest value against the last one at or before the period's start, null if there is none. Volatility is the
    sample deviation of step returns, downside deviation the root mean square of the negative ones, max_drawdown zero or below. Sortino:
    mean step return by downside deviation; calmar: yearly return by drawdown; risk_adjusted: the whole return by volatility. A ratio
    with a zero or missing denominator is 0. All of it is one pass over the numbered series and one aggregate.
    """
    x = values
    if start is not None:
        x = x.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    now = x.agg(F.max("ts")).scalar()
    r = drawdown(with_returns(x), "value")
    cutoff = {n: F.max_by("value", F.when(F.col("ts") <= now - F.make_dt_interval(F.lit(d)), F.col("ts"))).alias(f"_{n}") for n, d in SPANS.items()}
    ret, step = F.col("ret"), F.col("_rn") > 1
    g = r.groupBy("symbol").agg(
        F.max_by("value", "ts").alias("_now"), F.min_by("value", "ts").alias("_first"), *cutoff.values(), F.stddev_samp(F.when(step, ret)).alias("_vol"),
        F.max("drawdown").alias("_dd"), F.sqrt(F.avg(F.when(step, F.least(ret, F.lit(0.0)) * F.least(ret, F.lit(0.0))))).alias("_down"), F.avg(F.when(step, ret)).alias("_mean"))
    since = lambda c: div(F.col("_now") - F.col(c), c)
    ratio = lambda a, b: F.coalesce(div(a, b), F.lit(0.0))
    return g.select("symbol", *[since(f"_{n}").alias(n) for n in SPANS], ratio(since("_first"), F.col("_vol")).alias("risk_adjusted"), F.col("_vol").alias("volatility"),
                    (-F.col("_dd")).alias("max_drawdown"), F.col("_down").alias("downside_deviation"), ratio(F.col("_mean"), F.col("_down")).alias("sortino_ratio"),
                    ratio(since("_yearly"), F.col("_dd")).alias("calmar_ratio"))


def asset_correlations(vaults: DataFrame, assets: DataFrame, least: int = 10) -> DataFrame:
    """Correlation of each vault's step returns with each asset's over their common times (both: symbol, ts, ret; first steps left out)."""
    v = vaults.filter("_rn > 1").select("symbol", "ts", "ret")
    a = assets.filter("_rn > 1").select(F.col("symbol").alias("asset"), "ts", F.col("ret").alias("_other"))
    g = v.join(a, "ts").groupBy("symbol", "asset").agg(F.count(F.lit(1)).alias("points"), F.corr("ret", "_other").alias("correlation"))
    return g.filter(F.col("points") >= least).withColumn("correlation", F.coalesce(F.nanvl("correlation", F.lit(None)), F.lit(0.0)))


def value_at_risk(returns: DataFrame, keys=("symbol",), ret: str = "ret") -> DataFrame:
    """Positional VaR at 95 and 99 and the mean of the floor(n*0.05) lowest returns, as sizes."""
    keys = list(keys)
    q = exact_quantiles(returns, keys, ret, [0.05, 0.01], ["_v95", "_v99"], "position")
    below = F.col(ret) < F.col("_v95")
    t = returns.join(q, keys).groupBy(*keys).agg(
        F.max("_v95").alias("_v95"), F.max("_v99").alias("_v99"),
        F.floor(F.count(ret) * 0.05).alias("_k"),
        F.sum(F.when(below, F.col(ret))).alias("_s"), F.count_if(below).alias("_m"),
    )
    # rows equal to the cut value fill the tail up to k
    tail = F.coalesce(F.col("_s"), F.lit(0.0)) + (F.col("_k") - F.col("_m")) * F.col("_v95")
    return t.select(*keys, F.abs("_v95").alias("var_95"), F.abs("_v99").alias("var_99"),
                    F.abs(F.coalesce(div(tail, F.col("_k")), F.lit(0.0))).alias("expected_shortfall"))


def sharpe(ret: str) -> Column:
    """Mean over sample deviation, not annualised; 0 without deviation."""
    return F.coalesce(div(F.avg(ret), F.stddev_samp(ret)), F.lit(0.0))


def summary(returns: DataFrame, market: DataFrame) -> DataFrame:
    """Value, return, Sharpe, volatility, drawdown, alpha and beta of every portfolio.

    ``market`` has (ts, market_ret) and is aligned by date.
    """
    x = drawdown(returns, "value").join(market, "ts", "left")
    beta = F.coalesce(F.regr_slope("ret", "market_ret"), F.lit(0.0))
    out = x.groupBy("symbol").agg(
        F.max_by("value", "ts").alias("total_value"), F.min_by("value", "ts").alias("_first"),
        sharpe("ret").alias("sharpe_ratio"), F.stddev_samp("ret").alias("volatility"), F.max("drawdown").alias("max_drawdown"),
        beta.alias("beta"), (F.avg(F.when(F.col("market_ret").isNotNull(), F.col("ret"))) - beta * F.avg("market_ret")).alias("alpha"),
        F.count(F.lit(1)).alias("points"),
    )
    gain = F.col("total_value") - F.col("_first")
    return out.withColumns({
        "total_return": gain, "total_return_pct": F.when(F.col("_first") > 0, 100.0 * gain / F.col("_first")).otherwise(0.0),
    }).drop("_first")


def market_returns(market: DataFrame) -> DataFrame:
    """(ts, market) -> (ts, market_ret), first 0."""
    r = with_returns(market.select(F.lit("market").alias("symbol"), "ts", F.col("market").alias("value")))
    return r.select("ts", F.col("ret").alias("market_ret"))


def performance_record(returns: DataFrame, benchmark: DataFrame, per_year: float = 252.0, free: float = 0.0) -> DataFrame:
    """Annualised record against one or more benchmarks (benchmark, ts, bench_ret)."""
    keys = ["symbol", "benchmark"]
    x = drawdown(returns, "value").join(benchmark, "ts")
    down = F.when(F.col("ret") < 0, F.col("ret"))
    active = F.col("ret") - F.col("bench_ret")
    agg = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(down).alias("downside_deviation"), F.max("drawdown").alias("max_drawdown"),
        F.coalesce(F.regr_slope("ret", "bench_ret"), F.lit(0.0)).alias("beta"), F.avg("bench_ret").alias("_bm"),
        div(F.avg(active), F.stddev_samp(active)).alias("information_ratio"),
        F.skewness("ret").alias("skewness"), F.kurtosis("ret").alias("kurtosis"),
    )
    q = exact_quantiles(returns, ["symbol"], "ret", [0.05, 0.95], ["p05", "p95"])
    cvar = returns.join(q, "symbol").filter(F.col("ret") <= F.col("p05")).groupBy("symbol").agg(F.avg("ret").alias("cvar_95"))
    out = agg.join(q, "symbol").join(cvar, "symbol", "left")
    annual = F.col("mean") * per_year
    return out.select(
        *keys, "n", annual.alias("annualized_return"), (F.col("sd") * (per_year ** 0.5)).alias("annualized_volatility"),
        div(F.col("mean") - free, "sd").alias("sharpe_ratio"), div(F.col("mean") - free, "downside_deviation").alias("sortino_ratio"),
        div(annual, "max_drawdown").alias("calmar_ratio"), "max_drawdown", "beta",
        (F.col("mean") - F.col("beta") * F.col("_bm")).alias("alpha"), "information_ratio",
        div("p95", F.abs("p05")).alias("tail_ratio"), "skewness", "kurtosis", "cvar_95", "downside_deviation",
    )


def periodic_performance(returns: DataFrame, pattern: str = "yyyy-MM") -> DataFrame:
    """Return, volatility and Sharpe per calendar period."""
    return returns.groupBy("symbol", F.date_format("ts", pattern).alias("period")).agg(
        (F.exp(F.sum(F.log1p(F.when(F.col("ret") > -1, F.col("ret"))))) - 1.0).alias("period_return"),
        F.stddev_samp("ret").alias("volatility"), sharpe("ret").alias("sharpe_ratio"), F.count(F.lit(1)).alias("points"))


def concentration(weights: DataFrame, key: str = "portfolio") -> DataFrame:
    h = F.sum(F.col("weight") * F.col("weight"))
    return weights.groupBy(key).agg(h.alias("hhi"), (1.0 - h).alias("diversification"), F.max("weight").alias("max_weight"))


def weighted_risk(weights: DataFrame, states: DataFrame, signals: DataFrame) -> DataFrame:
    """Concentration, volatility, liquidity and sentiment risk with the overall score.

    ``states``: (asset, volatility, liquidity); ``signals``: (asset, risk_signals count).
    Missing volatility is 0.02, missing liquidity 1.
    """
    x = weights.join(states, "asset", "left").join(signals, "asset", "left")
    r = x.groupBy("portfolio").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("concentration_risk"),
        F.sum(F.col("weight") * F.coalesce("volatility", F.lit(0.02))).alias("volatility_risk"),
        F.sum(F.col("weight") * (1.0 - F.coalesce("liquidity", F.lit(1.0)))).alias("liquidity_risk"),
        F.least(F.sum(F.coalesce("risk_signals", F.lit(0)) * 0.1), F.lit(1.0)).alias("sentiment_risk"),
    )
    return r.withColumn("overall_risk", 0.3 * F.col("concentration_risk") + 0.35 * F.col("volatility_risk")
                        + 0.25 * F.col("liquidity_risk") + 0.1 * F.col("sentiment_risk"))


def pair_ratio(states: DataFrame) -> DataFrame:
    """Mean over asset pairs of min(price)/max(price), per state.

    Sorted by price, the pairs ending in asset j sum to (prices before j)/price_j, so a
    running sum replaces the pairs.
    """
    w = Window.partitionBy("ts").orderBy("price", "asset")
    before = F.sum("price").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = states.withColumn("_s", div(before, "price"))
    n = F.count(F.lit(1))
    return x.groupBy("ts").agg(F.coalesce(div(F.sum("_s"), n * (n - 1) / 2.0), F.lit(0.0)).alias("pair_ratio"))


def state_risk(states: DataFrame) -> DataFrame:
    """Risk of each market state: 0.3 volatility, 0.3 VaR share, 0.2 pair ratio, 0.2 illiquidity."""
    worth = F.col("price") * F.col("volume")
    s = states.groupBy("ts").agg(
        F.avg("volatility").alias("vol"), F.percentile(worth, F.lit(0.05)).alias("p5"), F.avg(worth).alias("mean_worth"),
        F.avg("liquidity").alias("liq"))
    s = s.join(pair_ratio(states), "ts")
    share = F.coalesce(div(F.abs("p5"), "mean_worth"), F.lit(0.0))
    total = 0.3 * F.col("vol") + 0.3 * share + 0.2 * F.col("pair_ratio") + 0.2 * (1.0 - F.col("liq"))
    return s.select("ts", "pair_ratio", share.alias("var_share"), clip(total, 0.0, 1.0).alias("risk_score"))


def allocate_from_scores(scores: DataFrame, cap: float = 0.2) -> DataFrame:
    """(ts, asset, score, risk_score) -> clip(score*(1-risk), 0, cap), normalised per ts."""
    a = clip(F.col("score") * (1.0 - F.col("risk_score")), 0.0, cap)
    x = scores.withColumn("_a", a)
    total = F.sum("_a").over(Window.partitionBy("ts"))
    return x.select("ts", "asset", F.when(total > 0, F.col("_a") / total).otherwise(F.col("_a")).alias("weight"))


def limit_allocations(weights: DataFrame, confidence: Column, cap: float = 0.2, threshold: float = 0.6,
                      stable: str = "USDC") -> DataFrame:
    """Renormalise, cap with equal redistribution (one simultaneous pass), scale by
    confidence, then move half of what exceeds 50 percent into the stable asset."""
    w = Window.partitionBy("portfolio")
    total = F.sum("weight").over(w)
    x = weights.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_w", F.when(F.abs(total - 1.0) > 0.01, F.col("weight") / total).otherwise(F.col("weight")))
    x = x.withColumn("_x", F.greatest(F.col("_w") - cap, F.lit(0.0)))
    others = F.sum("_x").over(w) - F.col("_x")
    x = x.withColumn("_w", F.least(F.col("_w"), F.lit(cap)) + F.coalesce(div(others, F.col("_n") - 1), F.lit(0.0)))
    x = x.withColumn("_w", F.col("_w") * F.least(confidence / threshold, F.lit(1.0)))
    first = F.row_number().over(w.orderBy(F.col("_w").desc(), "asset")) == 1
    cut = F.when(first & (F.col("_n") > 1) & (F.col("_w") > 0.5), (F.col("_w") - 0.5) * 0.5).otherwise(0.0)
    x = x.withColumn("_cut", cut)
    kept = x.select("portfolio", "asset", (F.col("_w") - F.col("_cut")).alias("weight"))
    moved = x.filter("_cut > 0").select("portfolio", F.lit(stable).alias("asset"), F.col("_cut").alias("weight"))
    return kept.unionByName(moved).groupBy("portfolio", "asset").agg(F.sum("weight").alias("weight"))


def fallback_allocation(weights: DataFrame, cap: float = 0.2, stable: str = "USDC") -> DataFrame:
    """Each weight capped, the remainder to the stable asset."""
    capped = weights.select("portfolio", "asset", F.least("weight", F.lit(cap)).alias("weight"))
    rest = capped.groupBy("portfolio").agg((1.0 - F.sum("weight")).alias("weight")).filter("weight > 0")
    both = capped.unionByName(rest.select("portfolio", F.lit(stable).alias("asset"), "weight"))
    return both.groupBy("portfolio", "asset").agg(F.sum("weight").alias("weight"))


def adjust_by_sentiment(weights: DataFrame, sentiment: DataFrame, strength: float = 0.15) -> DataFrame:
    """weight * (1 + score*confidence*strength), normalised; 1 without a score."""
    factor = F.coalesce(1.0 + F.col("score") * F.col("confidence") * strength, F.lit(1.0))
    x = weights.join(sentiment, "asset", "left").withColumn("_a", F.col("weight") * factor)
    total = F.sum("_a").over(Window.partitionBy("portfolio"))
    return x.select("portfolio", "asset", F.when(total > 0, F.col("_a") / total).otherwise(F.col("_a")).alias("weight"))


def allocation_drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """Largest weight difference over the union of assets; a missing weight is 0."""
    j = now.select("portfolio", "asset", F.col("weight").alias("_a")).join(
        before.select("portfolio", "asset", F.col("weight").alias("_b")), ["portfolio", "asset"], "full_outer")
    diff = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return j.groupBy("portfolio").agg(F.max(diff).alias("drift"))


def rebalance_trigger(rows: DataFrame, max_hours=24.0, max_volatility=0.05, max_drift=0.1, min_confidence=0.6) -> DataFrame:
    """Needs hours_since, volatility, drift, confidence."""
    hit = (
        (F.col("hours_since") >= max_hours) | (F.col("volatility") > max_volatility)
        | (F.coalesce("drift", F.lit(0.0)) > max_drift) | (F.col("confidence") < min_confidence)
    )
    return rows.withColumn("rebalance", hit)


def state_alerts(rows: DataFrame, key: str) -> DataFrame:
    """One row per alert; needs volatility, confidence, risk_score, max_weight."""
    def alert(cond, kind, severity, value):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))

    made = F.array_compact(F.array(
        alert(F.col("volatility") > 0.1, "high_volatility", "warning", F.col("volatility")),
        alert(F.col("confidence") < 0.5, "low_confidence", "warning", F.col("confidence")),
        alert(F.col("risk_score") > 0.8, "high_risk", "danger", F.col("risk_score")),
        alert(F.col("max_weight") > 0.5, "high_concentration", "warning", F.col("max_weight")),
    ))
    return rows.select(key, F.inline(made))


def regime(states: DataFrame) -> DataFrame:
    """Five classes from mean volatility, sentiment and volume of each state."""
    s = states.groupBy("ts").agg(
        F.avg("volatility").alias("volatility"), F.avg("sentiment").alias("sentiment"), F.avg("volume").alias("volume"),
        F.percentile("volume", F.lit(0.25)).alias("_q"))
    name = (
        F.when((F.col("volatility") > 0.05) & (F.col("sentiment") < 0.3), "BEAR_MARKET")
        .when((F.col("volatility") < 0.02) & (F.col("sentiment") > 0.7), "BULL_MARKET")
        .when(F.col("volatility") > 0.04, "HIGH_VOLATILITY")
        .when(F.col("volume") < F.col("_q"), "LOW_LIQUIDITY").otherwise("RANGING_MARKET"))
    return s.select("ts", name.alias("regime"), "volatility", "sentiment", "volume")


def key_drivers(states: DataFrame) -> DataFrame:
    """Per state: the asset with the top volume when above 1.5 times the mean, and the extreme sentiments."""
    return states.groupBy("ts").agg(
        F.when(F.max("volume") > 1.5 * F.avg("volume"), F.max_by("asset", F.struct("volume", "asset"))).alias("volume_driver"),
        F.when(F.max("volume") > 1.5 * F.avg("volume"), div(F.max("volume"), F.avg("volume"))).alias("volume_ratio"),
        F.count_if((F.col("sentiment") > 0.8) | (F.col("sentiment") < 0.2)).alias("extreme_sentiments"))


def expected_return(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """sum(w*(predicted-price)/price) * (1-risk/2), and the two drawdown estimates.

    A weight without a price expects no return; ``unpriced`` is the sum of such weights.
    """
    x = weights.join(prices, "asset", "left")
    gain = F.coalesce(div(F.col("predicted") - F.col("price"), "price"), F.lit(0.0))
    return x.groupBy("portfolio").agg(
        (F.sum(F.col("weight") * gain) * (1.0 - F.max("risk") * 0.5)).alias("expected_return"),
        F.least(F.max("volatility") + 2.0 * F.max("weight") + 0.5 * F.max("risk"), F.lit(0.5)).alias("drawdown_full"),
        F.least(0.5 * F.max("weight") + 0.3 * F.max("risk"), F.lit(0.5)).alias("drawdown_short"),
        F.sum(F.when(F.col("price").isNull(), F.col("weight")).otherwise(0.0)).alias("unpriced"))


# Stop-loss share by risk level (fixed values).
STOP_LOSS = {1: 0.02, 2: 0.03, 3: 0.05, 4: 0.07, 5: 0.10}


def trade_risk(trades: DataFrame) -> DataFrame:
    """Needs amount, price, direction (buy/sell), risk_level, portfolio_value."""
    table = F.create_map(*[F.lit(v) for kv in STOP_LOSS.items() for v in kv])
    stop = F.coalesce(F.try_element_at(table, F.col("risk_level").cast("int")), F.lit(0.05))
    loss = F.col("amount") * stop
    side = F.when(F.col("direction") == "buy", 1.0).otherwise(-1.0)
    share = div(loss, "portfolio_value")
    limit = 0.02 * F.col("portfolio_value")
    return trades.withColumns({
        "trade_value": F.col("amount") * F.col("price"),
        "stop_loss_price": F.col("price") * (1.0 - side * stop),
        "take_profit_price": F.col("price") * (1.0 + side * stop * 2.5),
        "max_loss": loss,
        "portfolio_risk_pct": F.when(F.col("portfolio_value") > 0, 100.0 * share).otherwise(0.0),
        "assessment": F.when(share < 0.02, "acceptable").otherwise("high"),
        "adjusted_amount": F.when((F.col("portfolio_value") > 0) & (share > 0.02), F.col("amount") * div(limit, loss)).otherwise(F.col("amount")),
    })

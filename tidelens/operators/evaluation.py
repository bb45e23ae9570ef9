"""Forecast, trading and model scores.

Prediction rows are (symbol, ts, _rn, y_true, y_pred, prev[, y_std, weight]); every score
is an aggregate per symbol, with exact distributed quantiles where a median is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import div
from ..functions.rolling import lag
from ..functions.special import normal_cdf, normal_pdf
from .portfolio import cumulative_growth, drawdown
from .ordered import numbered
from .quantile import exact_quantiles
from .series import blocks, number_rows, prefix, unblock


def _d() -> Column:
    return F.col("y_true") - F.col("y_pred")


def regression(pred: DataFrame, weighted: bool = False, more: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """rmse, mae, mape, r2, smape (percent), median and max absolute error, cv of rmse.

    ``more``: name -> function returning an aggregate Column, the user's own scores.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    y, e = F.col("y_true"), F.abs(_d())

    def mean(x):
        return div(F.sum(w * x), F.sum(w))

    both = F.abs(y) + F.abs("y_pred")
    smape = F.when(both == 0, 0.0).otherwise(2.0 * e / both)
    sst = mean(y * y) - mean(y) * mean(y) if weighted else F.var_pop(y)
    agg = pred.groupBy("symbol").agg(
        F.sqrt(mean(e * e)).alias("rmse"), mean(e).alias("mae"), mean(div(e, F.abs(y))).alias("mape"),
        (1.0 - div(mean(e * e), sst)).alias("r2"), (100.0 * mean(smape)).alias("smape"), F.max(e).alias("max_ae"),
        div(F.sqrt(mean(e * e)), F.avg(y)).alias("cv_rmse"),
        *[fn().alias(n) for n, fn in (more or {}).items()],
    )
    med = exact_quantiles(pred.withColumn("_e", e), ["symbol"], "_e", [0.5], ["median_ae"])
    return agg.join(med, "symbol")


def directional(pred: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Confusion scores of 'up against the previous value' (over ``threshold`` as a share)."""
    if threshold > 0:
        up = lambda c: div(F.col(c) - F.col("prev"), "prev") > threshold
    else:
        up = lambda c: F.col(c) > F.col("prev")
    t, p = F.coalesce(up("y_true"), F.lit(False)), F.coalesce(up("y_pred"), F.lit(False))
    cells = pred.groupBy("symbol").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return cells.select("symbol", "tp", "fp", "fn", "tn", *confusion_scores())


def confusion_scores() -> list[Column]:
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))

    def share(a, b):
        return F.coalesce(div(a, b), F.lit(0.0))

    tpr, tnr = share(tp, tp + fn), share(tn, tn + fp)
    prec = share(tp, tp + fp)
    return [
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"), tpr.alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("fpr"), tnr.alias("tnr"),
        share(fn, fn + tp).alias("fnr"), ((tpr + tnr) / 2.0).alias("balanced_accuracy"), share(tn, tn + fn).alias("npv"),
    ]


def strategy_returns(pred: DataFrame, fee: float = 0.001) -> DataFrame:
    """Direction, actual return and net strategy return of every row; needs ``_rn``."""
    x = pred.withColumns({
        "direction": F.signum(F.col("y_pred") - F.col("prev")),
        "actual": div(F.col("y_true") - F.col("prev"), "prev"),
    })
    x = blocks(x, 1).withColumn("change", F.abs(F.col("direction") - F.coalesce(lag("direction"), F.lit(0.0))))
    return unblock(x).withColumn("net", F.col("direction") * F.col("actual") - fee * F.col("change"))


def trading(pred: DataFrame, capital: float = 10000.0, fee: float = 0.001, free: float = 0.02 / 365) -> DataFrame:
    """Scores of a long/short strategy on the forecast; deviations are population ones."""
    x = cumulative_growth(strategy_returns(pred, fee), "net")
    x = drawdown(x.withColumn("value", capital * F.col("growth")), "value")
    net, excess = F.col("net"), F.col("net") - free
    active = net - F.col("actual")
    year = math.sqrt(252)
    pos, neg = F.when(net > 0, net), F.when(net < 0, net)
    a = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("growth", "_rn") - 1.0).alias("total_return"),
        F.avg(excess).alias("me"), F.stddev_pop(excess).alias("se"), F.stddev_pop(F.when(excess < 0, excess)).alias("sd"),
        F.max("drawdown").alias("max_drawdown"), F.count_if(net > 0).alias("wins"), F.count_if(F.col("change") > 0).alias("trades"),
        F.coalesce(F.sum(pos), F.lit(0.0)).alias("gp"), F.abs(F.coalesce(F.sum(neg), F.lit(0.0))).alias("gl"),
        F.coalesce(F.avg(F.when(F.col("change") > 0, net)), F.lit(0.0)).alias("avg_profit_per_trade"),
        F.coalesce(F.avg(pos), F.lit(0.0)).alias("aw"), F.abs(F.coalesce(F.avg(neg), F.lit(0.0))).alias("al"),
        F.stddev_pop(net).alias("vol"), F.stddev_pop(active).alias("sa"),
        F.covar_samp(net, F.col("actual")).alias("cv"), F.var_pop("actual").alias("va"),
        (div(F.max_by("y_true", "_rn"), F.min_by("y_true", "_rn")) - 1.0).alias("bench"),
    )

    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    power = 252.0 / F.col("n")
    annual = F.pow(1.0 + F.col("total_return"), power) - 1.0
    bench = F.pow(1.0 + F.col("bench"), power) - 1.0
    beta = zero(div("cv", "va"))
    wr = zero(div("wins", "trades"))
    return a.select(
        "symbol", "total_return", annual.alias("annualized_return"), zero(div("me", "se") * year).alias("sharpe_ratio"),
        zero(div("me", "sd") * year).alias("sortino_ratio"), "max_drawdown", zero(div(annual, "max_drawdown")).alias("calmar_ratio"),
        wr.alias("win_rate"), div("gp", "gl").alias("profit_factor"), "avg_profit_per_trade",
        (wr * F.col("aw") - (1.0 - wr) * F.col("al")).alias("expectancy"), (F.col("vol") * year).alias("volatility"),
        zero(div(annual - bench, F.col("sa") * year)).alias("information_ratio"), beta.alias("beta"),
        (annual - free * 252 - beta * (bench - free * 252)).alias("alpha"), "trades",
    )


def run_lengths(rows: DataFrame, state: str) -> DataFrame:
    """Adds ``run``: position inside the current run of equal ``state``; needs ``_rn``.

    The start of a run is a running maximum, so a run may span any number of blocks.
    """
    x = blocks(rows, 1)
    x = unblock(x.withColumn("_start", F.when(~F.col(state).eqNullSafe(lag(state)) | (F.col("_rn") == 1), F.col("_rn"))))
    x = prefix(x, {"_s": ("max", F.col("_start"))})
    return x.withColumn("run", F.col("_rn") - F.col("_s") + 1).drop("_s", "_start")


def streaks(rows: DataFrame, value: str) -> DataFrame:
    r = run_lengths(rows.withColumn("_sg", F.signum(value)), "_sg")
    return r.groupBy("symbol").agg(
        F.coalesce(F.max(F.when(F.col("_sg") > 0, F.col("run"))), F.lit(0)).cast("long").alias("max_consecutive_wins"),
        F.coalesce(F.max(F.when(F.col("_sg") < 0, F.col("run"))), F.lit(0)).cast("long").alias("max_consecutive_losses"))


def rank_rows(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """``_rn`` by (order, tie) ascending inside each key, over ranges of rows: neither a large key nor a common value is one task."""
    return numbered(df, keys, [order, tie], ties=True)


def rank_weighted(df: DataFrame, keys: list[str], by: str, value: str, tie: str, out: str) -> DataFrame:
    """Mean of ``value`` under linear weights 1..0 by descending ``by``."""
    x = rank_rows(df.withColumn("_neg", -F.col(by)), keys, "_neg", tie)
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, keys).withColumn("_w", 1.0 - F.coalesce(div(F.col("_rn") - 1, F.col("_n") - 1), F.lit(0.0)))
    return x.groupBy(*keys).agg(div(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias(out))


def defi(rows: DataFrame) -> DataFrame:
    """Needs symbol, ts, ret, pred, risk, liquidity, loss (impermanent), gas."""
    k = ["symbol"]
    med = exact_quantiles(rows, k, "liquidity", [0.5], ["_m"])
    high = F.col("liquidity") > F.col("_m")
    r, g = F.col("ret"), F.col("gas")
    agg = rows.join(med, k).groupBy(*k).agg(
        F.avg(div(r, "risk")).alias("risk_adjusted_return"), F.coalesce(div(F.sum(r), F.sum("risk")), F.lit(0.0)).alias("risk_return_efficiency"),
        F.coalesce(div(F.sum(r * F.col("liquidity")), F.sum("liquidity")), F.lit(0.0)).alias("liquidity_weighted_return"),
        (F.coalesce(F.avg(F.when(~high, r)), F.lit(0.0)) - F.coalesce(F.avg(F.when(high, r)), F.lit(0.0))).alias("illiquidity_premium"),
        F.avg("loss").alias("avg_impermanent_loss"), F.avg(r - F.col("loss")).alias("il_adjusted_return"),
        F.when(F.avg(r) > 0, F.avg("loss") / F.avg(r)).alias("il_ratio"), F.avg(r - g).alias("gas_adjusted_return"),
        F.coalesce(F.avg(F.when(g > 0, div(r, g))), F.lit(0.0)).alias("gas_efficiency"),
        F.when(F.sum(r) > 0, F.sum(g) / F.sum(r)).alias("gas_cost_ratio"),
        F.sqrt(F.avg(F.pow(r - F.col("pred"), 2.0))).alias("returns_rmse"),
        F.avg(F.when(F.signum(r) == F.signum("pred"), 1.0).otherwise(0.0)).alias("directional_accuracy"))
    best = rank_weighted(rows, k, "ret", "ret", "ts", "_best")
    got = rank_weighted(rows, k, "pred", "ret", "ts", "_got")
    out = agg.join(best, k).join(got, k)
    return out.withColumns({
        "opportunity_cost": F.col("_best") - F.col("_got"),
        "allocation_efficiency": F.when(F.col("_best") > 0, F.col("_got") / F.col("_best")).otherwise(0.0),
    }).drop("_best", "_got")


def portfolio_scores(asset_returns: DataFrame, weights: DataFrame, best: DataFrame, free: float = 0.02 / 252) -> DataFrame:
    """asset_returns (ts, asset, ret); weights and ``best`` (asset, weight), normalised here.

    An asset that only one of the two allocations holds weighs 0 in the other; one without returns adds nothing to any day."""
    def norm(w, name):
        total = w.agg(F.sum("weight")).scalar()
        return w.select("asset", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")).alias(name))

    w = norm(weights, "w").join(norm(best, "o"), "asset", "full_outer").fillna(0.0, ["w", "o"])
    daily = asset_returns.join(w, "asset").groupBy("ts").agg(
        F.sum(F.col("ret") * F.col("w")).alias("ret"), F.sum(F.col("ret") * F.col("o")).alias("opt"))
    x = number_rows(daily.withColumn("symbol", F.lit("portfolio")))
    x = drawdown(cumulative_growth(x, "ret"), "growth")
    diff = F.col("ret") - F.col("opt")
    s = x.agg(
        F.avg("ret").alias("expected_return"), F.stddev_pop("ret").alias("volatility"),
        F.coalesce(F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))), F.lit(0.0)).alias("downside_volatility"),
        F.max("drawdown").alias("max_drawdown"), F.stddev_pop(diff).alias("tracking_error"), F.avg(diff).alias("_md"),
        F.avg("opt").alias("_mo"), F.stddev_pop("opt").alias("_so"))
    q = w.agg((1.0 - F.sum(F.col("w") * F.col("w"))).alias("diversification"),
              F.sqrt(F.avg(F.pow(F.col("o") - F.col("w"), 2.0))).alias("weight_rmse"),
              F.coalesce(F.corr("o", "w"), F.lit(0.0)).alias("weight_correlation"))
    one = F.lit(1).alias("_k")
    r = s.select("*", one).join(q.select("*", one), "_k")

    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    sharpe = zero(div(F.col("expected_return") - free, "volatility"))
    best_sharpe = zero(div(F.col("_mo") - free, "_so"))
    return r.select(
        "expected_return", "volatility", sharpe.alias("sharpe_ratio"), "downside_volatility",
        zero(div(F.col("expected_return") - free, "downside_volatility")).alias("sortino_ratio"), "max_drawdown",
        zero(div(F.pow(1.0 + F.col("expected_return"), 252.0) - 1.0, "max_drawdown")).alias("calmar_ratio"),
        "diversification", "weight_rmse", "weight_correlation", "tracking_error",
        zero(div("_md", "tracking_error")).alias("information_ratio"),
        F.when(best_sharpe > 0, sharpe / best_sharpe).alias("relative_sharpe"))


COVERAGE = (0.5, 0.8, 0.9, 0.95, 0.99)
INTERVALS = (0.05, 0.1, 0.2)


def calibration(pred: DataFrame) -> DataFrame:
    """z scores, likelihood, coverage error at five levels, CRPS, interval score at three."""
    x = pred.filter(F.col("y_std") > 0).withColumn("z", _d() / F.col("y_std")).withColumn("az", F.abs("z"))
    probs = sorted({*COVERAGE, *[1 - a for a in INTERVALS]})
    name = {p: f"_q{int(round(p * 100))}" for p in probs}
    q = exact_quantiles(x, ["symbol"], "az", probs, [name[p] for p in probs])
    x = x.join(q, "symbol")
    s = F.col("y_std")
    aggs = [
        F.avg("z").alias("z_score_mean"), F.stddev_pop("z").alias("z_score_std"),
        F.avg(0.5 * F.log(2 * math.pi * s * s) + 0.5 * F.col("z") * F.col("z")).alias("mean_nll"),
        F.avg(s * (1 / math.sqrt(math.pi) - 2.0 * normal_pdf("z") - F.col("z") * (2.0 * normal_cdf("z") - 1.0))).alias("mean_crps"),
    ]
    for p in COVERAGE:
        aggs.append(F.abs(F.avg(F.when(F.col("az") <= F.col(name[p]), 1.0).otherwise(0.0)) - p).alias(f"_c{name[p]}"))
    for a in INTERVALS:
        half = F.col(name[1 - a]) * s
        under = F.greatest(F.col("y_pred") - half - F.col("y_true"), F.lit(0.0))
        over = F.greatest(F.col("y_true") - F.col("y_pred") - half, F.lit(0.0))
        aggs.append(F.avg(2.0 * half + (2.0 / a) * (under + over)).alias(f"_i{name[1 - a]}"))
    r = x.groupBy("symbol").agg(*aggs)
    cov = [F.col(f"_c{name[p]}") for p in COVERAGE]
    ivs = [F.col(f"_i{name[1 - a]}") for a in INTERVALS]
    return r.select("symbol", "z_score_mean", "z_score_std", "mean_nll", "mean_crps",
                    (sum(cov[1:], cov[0]) / len(cov)).alias("mean_coverage_error"), F.greatest(*cov).alias("max_coverage_error"),
                    (sum(ivs[1:], ivs[0]) / len(ivs)).alias("mean_interval_score"))


def robustness(runs: DataFrame) -> DataFrame:
    """runs: (symbol, row, perturbation, y_true, y_pred, y_new); two aggregation levels."""
    per_row = runs.groupBy("symbol", "row").agg(
        F.var_pop("y_new").alias("v"), F.avg("y_new").alias("m"), (F.max("y_new") - F.min("y_new")).alias("d"), F.max("y_pred").alias("y"))
    a = per_row.groupBy("symbol").agg(
        F.avg("v").alias("mean_pred_variance"),
        F.avg(F.when(F.abs("m") < 1e-10, 0.0).otherwise(F.sqrt("v") / F.abs("m"))).alias("mean_pred_cv"),
        F.avg("d").alias("mean_max_diff"), F.avg(div("d", F.abs("y"))).alias("relative_max_diff"),
        (1.0 - F.avg(F.col("v") / (F.col("y") * F.col("y") + 1e-10))).alias("stability_score"))
    per_run = runs.groupBy("symbol", "perturbation").agg(
        F.avg(F.when(F.signum("y_new") == F.signum("y_pred"), 1.0).otherwise(0.0)).alias("c"),
        F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_new"), 2.0))).alias("e"),
        F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2.0))).alias("e0"))
    b = per_run.groupBy("symbol").agg(F.avg("c").alias("direction_consistency"), div(F.avg("e") - F.max("e0"), F.max("e0")).alias("rmse_degradation"))
    return a.join(b, "symbol")


def time_series(pred: DataFrame, horizon: int = 1) -> DataFrame:
    """MASE, nRMSE, Theil U2, lag-1 residual autocorrelation, bias, tracking signal."""
    x = blocks(pred.withColumn("_r", _d()), horizon)
    x = unblock(x.withColumns({"_yh": lag("y_true", horizon), "_y1": lag("y_true"), "_r1": lag("_r")}))
    mean = x.groupBy("symbol").agg(F.avg("_r").alias("_mr"))
    x = x.join(mean, "symbol")
    y, r = F.col("y_true"), F.col("_r")
    e = F.col("_r") - F.col("_mr")
    ac, pc = div(y - F.col("_y1"), "_y1"), div(F.col("y_pred") - F.col("_y1"), "_y1")
    a = x.groupBy("symbol").agg(
        F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.avg(F.abs(y - F.col("_yh"))).alias("_naive"),
        (F.max(y) - F.min(y)).alias("_range"), F.sum((pc - ac) * (pc - ac)).alias("_tn"), F.sum(ac * ac).alias("_td"),
        F.sum(e * (F.col("_r1") - F.col("_mr"))).alias("_an"), F.sum(e * e).alias("_ad"), F.avg(-r).alias("bias"), F.avg(y).alias("_my"))
    return a.select("symbol", "rmse", "mae", div("mae", "_naive").alias("mase"), div("rmse", "_range").alias("nrmse"),
                    F.sqrt(div("_tn", "_td")).alias("theil_u2"), F.coalesce(div("_an", "_ad"), F.lit(0.0)).alias("residual_autocorr"),
                    "bias", div("bias", "_my").alias("relative_bias"), div(-F.col("bias"), "mae").alias("tracking_signal"))


def signal_scores(rows: DataFrame) -> DataFrame:
    """rows: symbol, _rn, change, signal (-1, 0, 1)."""
    s, ch = F.col("signal"), F.col("change")
    right = ((s == 1) & (ch > 0)) | ((s == -1) & (ch < 0)) | ((s == 0) & (F.abs(ch) < 0.01))
    x = rows.withColumn("_t", s * ch)
    x = prefix(x, {"_c": ("sum", F.col("_t"))})
    x = prefix(x, {"_p": ("max", F.col("_c"))})
    return x.groupBy("symbol").agg(
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("signal_accuracy"), F.sum("_t").alias("total_return"),
        F.avg(F.when(s != 0, F.col("_t"))).alias("mean_return_per_trade"), F.avg(F.when(F.col("_t") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        (div(F.avg("_t"), F.stddev_pop("_t") + 1e-10) * math.sqrt(252)).alias("sharpe_ratio"), F.max(F.col("_p") - F.col("_c")).alias("max_drawdown"))


def confusion_matrix(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the confusion counts."""
    m = confusion_matrix(rows, actual, predicted)
    a = m.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("hit"))
    p = m.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    x = a.join(p, "label", "left").select("support", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("called", F.lit(0)).alias("called"))
    prec, rec = F.coalesce(div("hit", "called"), F.lit(0.0)), div("hit", "support")
    f1 = F.coalesce(div(2.0 * prec * rec, prec + rec), F.lit(0.0))
    w = F.col("support")
    return x.agg(div(F.sum("hit"), F.sum(w)).alias("accuracy"), div(F.sum(prec * w), F.sum(w)).alias("precision"),
                 div(F.sum(rec * w), F.sum(w)).alias("recall"), div(F.sum(f1 * w), F.sum(w)).alias("f1"))


def roc_auc(rows: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """AUC from counts per distinct score; equal scores share their rank."""
    d = rows.groupBy(key, score).agg(F.sum(label).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg"))
    x = rank_rows(d.withColumn("_tie", F.lit(0)), [key], score, "_tie")
    x = prefix(x, {"_below": ("sum", F.col("_neg"))}, (key,))
    pairs = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0))
    return x.groupBy(key).agg(div(pairs, F.sum("_pos") * F.sum("_neg")).alias("auc"))


def batch_validation(pred: DataFrame) -> DataFrame:
    """mse, mae and agreement of successive directions of truth and forecast."""
    x = blocks(pred, 1)
    x = unblock(x.withColumns({"_a": F.signum(F.col("y_true") - lag("y_true")), "_b": F.signum(F.col("y_pred") - lag("y_pred"))}))
    return x.groupBy("symbol").agg(F.avg(_d() * _d()).alias("mse"), F.avg(F.abs(_d())).alias("mae"),
                                   F.avg(F.when(F.col("_a").isNotNull(), F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0))).alias("direction_accuracy"))


def drift_score(current: DataFrame, reference: DataFrame, vector: str) -> DataFrame:
    """tanh of the mean shift of each feature in reference deviations."""
    def stats(df, tag):
        return df.select(F.posexplode(vector)).groupBy("pos").agg(
            F.avg(F.col("col").cast("double")).alias(f"m{tag}"), F.stddev_pop(F.col("col").cast("double")).alias(f"s{tag}"))

    j = stats(current, "c").join(stats(reference, "r"), "pos")
    shift = F.abs(F.col("mc") - F.col("mr")) / (F.col("sr") + 1e-6)
    return j.agg(F.tanh(F.avg(shift)).alias("drift_score"), F.max(shift).alias("max_shift"), F.count(F.lit(1)).alias("features"))


# --- score registry: (model, version, dataset, env, ts, tags, metrics MAP) ----------------


def find_scores(registry: DataFrame, model=None, version=None, dataset=None, env=None, tags=(), since=None, until=None) -> DataFrame:
    for name, v in (("model", model), ("version", version), ("dataset", dataset), ("env", env)):
        if v is not None:
            registry = registry.filter(F.col(name) == v)
    for t in tags:
        registry = registry.filter(F.array_contains("tags", t))
    if since is not None:
        registry = registry.filter(F.col("ts") >= since)
    if until is not None:
        registry = registry.filter(F.col("ts") <= until)
    return registry


def compare_models(registry: DataFrame, metrics: list[str]) -> DataFrame:
    """Newest value of each metric per model."""
    return registry.groupBy("model").agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("entries"), *[F.max_by(F.col("metrics")[m], "ts").alias(m) for m in metrics])


def degradation(registry: DataFrame, metric: str, threshold: float = 0.1, higher_is_better: bool = False) -> DataFrame:
    """Newest against previous value per model: relative change and the flag."""
    w = Window.partitionBy("model").orderBy(F.col("ts").desc())
    two = registry.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy("model").agg(
        F.max(F.when(F.col("_r") == 1, F.col("metrics")[metric])).alias("current"),
        F.max(F.when(F.col("_r") == 2, F.col("metrics")[metric])).alias("previous"))
    change = div(F.col("current") - F.col("previous"), F.abs("previous"))
    worse = -change if higher_is_better else change
    return two.filter(F.col("previous").isNotNull()).select("model", "current", "previous", change.alias("relative_change"), (worse > threshold).alias("degraded"))


def improvement(pairs: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """pairs (model, baseline, value): percent improvement over the baseline."""
    gain = F.col("baseline") - F.col("value") if lower_is_better else F.col("value") - F.col("baseline")
    return pairs.select("model", (100.0 * div(gain, F.abs("baseline"))).alias("improvement_pct"))


def best_model(scores: DataFrame, primary: str, secondary: list[str]) -> DataFrame:
    """Lowest primary score, ties by the secondary ones, then by name: a one-row limit."""
    return scores.orderBy(primary, *secondary, "model").limit(1)


def permutation_importance(losses: DataFrame) -> DataFrame:
    """losses (feature, repeat, base_loss, loss): mean increase, normalised by the largest."""
    inc = losses.groupBy("feature").agg(F.greatest(F.avg(F.col("loss") - F.col("base_loss")), F.lit(0.0)).alias("increase"))
    top = inc.agg(F.max("increase")).scalar()
    return inc.select("feature", "increase", F.coalesce(div("increase", top), F.lit(0.0)).alias("importance"))


def ensemble_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("models"))

"""Forecast and model evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd, rounded
from ..functions.rolling import lag, mean, std
from ..operators import evaluation as E
from ..operators.series import blocks, unblock
from ..sources import bars as B
from ..sources.domain import HISTORY_SQL, protocol_history
from ..sources.tables import table
from .catalog import query
from .sqlkit import EVENT_BARS, L, R

_W = "OVER (PARTITION BY symbol ORDER BY ts)"
PRED = EVENT_BARS + f""",
p0 AS (SELECT *, row_number() {_W} AS rn0, {L('close')} AS prev, {R('avg', 'close', 3)} AS a3, {R('stddev_samp', 'close', 20)} AS s20 FROM bars),
p1 AS (SELECT symbol, ts, rn0 - 20 AS rn, close AS y_true, lag(a3) {_W} AS y_pred, prev, lag(s20) {_W} AS y_std, volume + 1 AS weight FROM p0),
pred AS (SELECT * FROM p1 WHERE rn >= 1)"""


def predictions(spark, root):
    """The next close forecast by the mean of the last three; spread by the last twenty."""
    x = blocks(B.numbered(B.event_bars(spark, root)), 21)
    x = x.withColumns({"_a": mean("close", 3), "_s": std("close", 20)})
    x = unblock(x.withColumns({"prev": lag("close"), "y_pred": lag("_a"), "y_std": lag("_s")}))
    return x.filter("_rn > 20").select("symbol", "ts", (F.col("_rn") - 20).alias("_rn"), F.col("close").alias("y_true"), "y_pred", "prev",
                                       "y_std", (F.col("volume") + 1).alias("weight"))


def _round_all(df, digits=5, skip=("symbol", "ts")):
    return df.select(*[rnd(c, digits).alias(c) if c not in skip and df.schema[c].dataType.typeName() == "double" else F.col(c) for c in df.columns])


def _reg(w):
    m = lambda x: f"sum({w} * ({x})) / sum({w})"
    return f"""WITH {PRED}, e AS (SELECT *, y_true - y_pred AS d FROM pred)
SELECT symbol, round(sqrt({m('d * d')}), 5) AS rmse, round({m('abs(d)')}, 5) AS mae, round({m('abs(d) / abs(y_true)')}, 5) AS mape,
 round(1 - ({m('d * d')}) / ({m('y_true * y_true')} - pow({m('y_true')}, 2)), 5) AS r2, round(100 * {m('2 * abs(d) / (abs(y_true) + abs(y_pred))')}, 5) AS smape,
 round(max(abs(d)), 5) AS max_ae, round(sqrt({m('d * d')}) / avg(y_true), 5) AS cv_rmse, round(median(abs(d)), 5) AS median_ae{{more}} FROM e GROUP BY 1"""


@query("regression_metrics", "EV-1 UD-5", _reg("1.0").format(more=", round(max(d), 5) AS worst_under, round(avg(pow(abs(d), 0.5)), 5) AS root_loss"))
def regression_metrics(spark, root):
    d = lambda: F.col("y_true") - F.col("y_pred")
    return _round_all(E.regression(predictions(spark, root), more={"worst_under": lambda: F.max(d()), "root_loss": lambda: F.avg(F.sqrt(F.abs(d())))}))


@query("regression_metrics_weighted", "EV-1", _reg("weight").format(more=""))
def regression_metrics_weighted(spark, root):
    return _round_all(E.regression(predictions(spark, root), weighted=True))


def _conf(up_t, up_p):
    c = "coalesce({}, 0)"
    sh = lambda a, b: f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 9)"
    return f"""WITH {PRED}, c AS (SELECT symbol, count(*) FILTER ({up_t} AND {up_p}) AS tp, count(*) FILTER (NOT {up_t} AND {up_p}) AS fp, count(*) FILTER ({up_t} AND NOT {up_p}) AS fn,
 count(*) FILTER (NOT {up_t} AND NOT {up_p}) AS tn FROM pred GROUP BY 1) SELECT symbol, tp, fp, fn, tn, {sh('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {sh('tp', 'tp + fp')} AS "precision", {sh('tp', 'tp + fn')} AS recall,
 {sh('2 * tp', '2 * tp + fp + fn')} AS f1, {sh('fp', 'fp + tn')} AS fpr, {sh('tn', 'tn + fp')} AS tnr, {sh('fn', 'fn + tp')} AS fnr,
 round((coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy, {sh('tn', 'tn + fn')} AS npv FROM c"""


@query("directional_metrics", "EV-2", _conf("(y_true > prev)", "(y_pred > prev)"))
def directional_metrics(spark, root):
    return _round_all(E.directional(predictions(spark, root)), 9)


@query("directional_metrics_threshold", "EV-2", _conf("((y_true - prev) / prev > 0.05)", "((y_pred - prev) / prev > 0.05)"))
def directional_metrics_threshold(spark, root):
    return _round_all(E.directional(predictions(spark, root), 0.05), 9)


_STRAT = f"""{PRED}, d0 AS (SELECT *, sign(y_pred - prev) AS dir, (y_true - prev) / prev AS act FROM pred), d1 AS (SELECT *, abs(dir - coalesce(lag(dir) {_W}, 0)) AS chg FROM d0),
d2 AS (SELECT *, dir * act / 1000 - 0.001 * chg AS net, act / 1000 AS actual FROM d1)"""
_Z = "coalesce({}, 0)"


def _damped(spark, root):
    """Prices pulled to their previous value a thousandfold, so that returns stay above -1."""
    p = predictions(spark, root)
    return p.withColumn("y_true", F.col("prev") + (F.col("y_true") - F.col("prev")) / 1000.0).withColumn("y_pred", F.col("prev") + (F.col("y_pred") - F.col("prev")) / 1000.0)


_BENCH = "(arg_max(y_small, rn) / arg_min(y_small, rn) - 1)"


@query("trading_metrics", "EV-3 SG-11", f"""WITH {_STRAT}, g AS (SELECT *, prev + (y_true - prev) / 1000 AS y_small, exp(sum(ln(1 + net)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS growth FROM d2),
dd AS (SELECT *, 1 - growth / max(growth) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drawdown FROM g),
a AS (SELECT symbol, count(*) AS n, arg_max(growth, rn) - 1 AS tr, avg(net - 0.02 / 365) AS me, stddev_pop(net) AS se, stddev_pop(net - 0.02 / 365) FILTER (net < 0.02 / 365) AS sd, max(drawdown) AS mdd,
 count(*) FILTER (net > 0) AS wins, count(*) FILTER (chg > 0) AS trades, coalesce(sum(net) FILTER (net > 0), 0) AS gp, abs(coalesce(sum(net) FILTER (net < 0), 0)) AS gl, avg(net) FILTER (chg > 0) AS apt,
 coalesce(avg(net) FILTER (net > 0), 0) AS aw, abs(coalesce(avg(net) FILTER (net < 0), 0)) AS al, stddev_pop(net - actual) AS sa, covar_samp(net, actual) AS cv, var_pop(actual) AS va, {_BENCH} AS bench FROM dd GROUP BY 1),
b AS (SELECT *, pow(1 + tr, 252.0 / n) - 1 AS ann, pow(1 + bench, 252.0 / n) - 1 AS bann, cv / va AS beta, CAST(wins AS DOUBLE) / trades AS wr FROM a)
SELECT symbol, round(tr, 5) AS total_return, round(ann, 5) AS annualized_return, round(me / se * sqrt(252), 4) AS sharpe_ratio, round(me / sd * sqrt(252), 4) AS sortino_ratio, round(mdd, 5) AS max_drawdown, round(ann / mdd, 5) AS calmar_ratio,
 round(wr, 5) AS win_rate, round(gp / gl, 5) AS profit_factor, round(apt, 6) AS avg_profit_per_trade, round(wr * aw - (1 - wr) * al, 6) AS expectancy, round(se * sqrt(252), 5) AS volatility,
 round((ann - bann) / (sa * sqrt(252)), 5) AS information_ratio, round(beta, 5) AS beta, round(ann - 0.02 / 365 * 252 - beta * (bann - 0.02 / 365 * 252), 5) AS alpha, trades FROM b""")
def trading_metrics(spark, root):
    out = E.trading(_damped(spark, root))
    out = rounded(out, ["avg_profit_per_trade", "expectancy"])
    out = rounded(out, ["sharpe_ratio", "sortino_ratio"], 4)
    return rounded(out, ["total_return", "annualized_return", "max_drawdown", "calmar_ratio", "win_rate", "profit_factor", "volatility", "information_ratio", "beta", "alpha"], 5)


@query("max_streaks", "EV-4", f"""WITH {_STRAT}, r AS (SELECT *, row_number() {_W} - row_number() OVER (PARTITION BY symbol, sign(net) ORDER BY ts) AS isl FROM d2), s AS (SELECT symbol, sign(net) AS sg, isl, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT symbol, coalesce(max(n) FILTER (sg > 0), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (sg < 0), 0) AS max_consecutive_losses FROM s GROUP BY 1""")
def max_streaks(spark, root):
    return E.streaks(E.strategy_returns(_damped(spark, root)), "net")


_DEFI = f"""{PRED}, df AS (SELECT symbol, ts, (y_true - prev) / prev AS ret, (y_pred - prev) / prev AS pred, y_std AS risk, weight AS liquidity, y_std / 1000 AS loss, (weight % 7) / 1000 AS gas FROM pred),
rk AS (SELECT *, 1 - (row_number() OVER (PARTITION BY symbol ORDER BY ret DESC, ts) - 1.0) / (count(*) OVER (PARTITION BY symbol) - 1) AS wb, 1 - (row_number() OVER (PARTITION BY symbol ORDER BY pred DESC, ts) - 1.0) / (count(*) OVER (PARTITION BY symbol) - 1) AS wp,
 median(liquidity) OVER (PARTITION BY symbol) AS ml FROM df)"""


@query("defi_metrics", "EV-5 SRT-9", f"""WITH {_DEFI} SELECT symbol, round(avg(ret / risk), 6) AS risk_adjusted_return, round(sum(ret) / sum(risk), 6) AS risk_return_efficiency, round(sum(ret * liquidity) / sum(liquidity), 5) AS liquidity_weighted_return,
 round(avg(ret) FILTER (liquidity <= ml) - avg(ret) FILTER (liquidity > ml), 5) AS illiquidity_premium, round(avg(loss), 6) AS avg_impermanent_loss, round(avg(ret - loss), 5) AS il_adjusted_return, round(CASE WHEN avg(ret) > 0 THEN avg(loss) / avg(ret) END, 6) AS il_ratio,
 round(avg(ret - gas), 5) AS gas_adjusted_return, round(avg(ret / gas) FILTER (gas > 0), 2) AS gas_efficiency, round(CASE WHEN sum(ret) > 0 THEN sum(gas) / sum(ret) END, 6) AS gas_cost_ratio, round(sqrt(avg(pow(ret - pred, 2))), 5) AS returns_rmse,
 round(avg(CASE WHEN sign(ret) = sign(pred) THEN 1.0 ELSE 0.0 END), 5) AS directional_accuracy, round(sum(wb * ret) / sum(wb) - sum(wp * ret) / sum(wp), 5) AS opportunity_cost,
 round(CASE WHEN sum(wb * ret) > 0 THEN (sum(wp * ret) / sum(wp)) / (sum(wb * ret) / sum(wb)) ELSE 0 END, 5) AS allocation_efficiency FROM rk GROUP BY 1""")
def defi_metrics(spark, root):
    p = predictions(spark, root)
    rows = p.select("symbol", "ts", ((F.col("y_true") - F.col("prev")) / F.col("prev")).alias("ret"), ((F.col("y_pred") - F.col("prev")) / F.col("prev")).alias("pred"),
                    F.col("y_std").alias("risk"), F.col("weight").alias("liquidity"), (F.col("y_std") / 1000).alias("loss"), (F.col("weight") % 7 / 1000).alias("gas"))
    out = E.defi(rows)
    out = rounded(out, ["risk_adjusted_return", "risk_return_efficiency", "avg_impermanent_loss", "il_ratio", "gas_cost_ratio"])
    out = rounded(out, ["gas_efficiency"], 2)
    return rounded(out, ["liquidity_weighted_return", "illiquidity_premium", "il_adjusted_return", "gas_adjusted_return", "returns_rmse", "directional_accuracy", "opportunity_cost", "allocation_efficiency"], 5)


_AR = EVENT_BARS + f""", ar AS (SELECT ts, symbol AS asset, (close - {L('close')}) / {L('close')} / 100 AS ret, symbol FROM bars), wt AS (SELECT symbol AS asset, avg(volume) AS weight, avg(close) AS best FROM bars GROUP BY 1),
nw AS (SELECT asset, weight / sum(weight) OVER () AS w, best / sum(best) OVER () AS o FROM wt), dr AS (SELECT ts, sum(ret * w) AS ret, sum(ret * o) AS opt FROM ar JOIN nw USING (asset) WHERE ret IS NOT NULL GROUP BY 1),
gr AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS g FROM dr), gd AS (SELECT *, 1 - g / max(g) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd FROM gr),
s AS (SELECT avg(ret) AS m, stddev_pop(ret) AS v, stddev_pop(ret) FILTER (ret < 0) AS dv, max(dd) AS mdd, stddev_pop(ret - opt) AS te, avg(ret - opt) AS md, avg(opt) AS mo, stddev_pop(opt) AS so FROM gd)"""


@query("portfolio_metrics", "EV-6", f"""WITH {_AR} SELECT round(m, 6) AS expected_return, round(v, 6) AS volatility, round((m - 0.02 / 252) / v, 5) AS sharpe_ratio, round(dv, 6) AS downside_volatility, round((m - 0.02 / 252) / dv, 5) AS sortino_ratio,
 round(mdd, 5) AS max_drawdown, round((pow(1 + m, 252) - 1) / mdd, 4) AS calmar_ratio, (SELECT round(1 - sum(w * w), 6) FROM nw) AS diversification, (SELECT round(sqrt(avg(pow(o - w, 2))), 6) FROM nw) AS weight_rmse,
 (SELECT round(corr(o, w), 5) FROM nw) AS weight_correlation, round(te, 6) AS tracking_error, round(md / te, 5) AS information_ratio, round(((m - 0.02 / 252) / v) / ((mo - 0.02 / 252) / so), 5) AS relative_sharpe FROM s""")
def portfolio_metrics(spark, root):
    from ..functions.rolling import pct

    b = B.event_bars(spark, root)
    ar = unblock(blocks(B.numbered(b), 1).withColumn("ret", pct("close") / 100.0)).filter("ret IS NOT NULL").select("ts", F.col("symbol").alias("asset"), "ret")
    w = b.groupBy(F.col("symbol").alias("asset")).agg(F.avg("volume").alias("weight"))
    o = b.groupBy(F.col("symbol").alias("asset")).agg(F.avg("close").alias("weight"))
    out = E.portfolio_scores(ar, w, o)
    out = rounded(out, ["expected_return", "volatility", "downside_volatility", "diversification", "weight_rmse", "tracking_error"])
    return rounded(rounded(out, ["calmar_ratio"], 4), ["sharpe_ratio", "sortino_ratio", "max_drawdown", "weight_correlation", "information_ratio", "relative_sharpe"], 5)


def _erf_sql(x):
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    return f"(sign({x}) * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}))))"


_CAL_Q = {50: "0.5", 80: "0.8", 90: "0.9", 95: "0.95", 99: "0.99"}


@query("calibration_metrics", "EV-7 FN-5", f"""WITH {PRED}, z AS (SELECT *, (y_true - y_pred) / y_std AS z FROM pred WHERE y_std > 0), q AS (SELECT symbol, """ + ", ".join(
    f"quantile_cont(abs(z), {p}) AS q{k}" for k, p in _CAL_Q.items()) + f""" FROM z GROUP BY 1),
a AS (SELECT symbol, avg(z) AS zm, stddev_pop(z) AS zs, avg(0.5 * ln(2 * pi() * y_std * y_std) + 0.5 * z * z) AS nll, avg(y_std * (1 / sqrt(pi()) - 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - z * {_erf_sql('(z / sqrt(2))')})) AS crps, """ + ", ".join(
    f"abs(avg(CASE WHEN abs(z) <= q{k} THEN 1.0 ELSE 0.0 END) - {p}) AS c{k}" for k, p in _CAL_Q.items()) + ", " + ", ".join(
    f"avg(2 * q{k} * y_std + {2 / a} * (greatest(y_pred - q{k} * y_std - y_true, 0) + greatest(y_true - y_pred - q{k} * y_std, 0))) AS i{k}" for k, a in ((95, 0.05), (90, 0.1), (80, 0.2))) + """ FROM z JOIN q USING (symbol) GROUP BY 1)
SELECT symbol, round(zm, 5) + 0.0 AS z_score_mean, round(zs, 5) AS z_score_std, round(nll, 5) AS mean_nll, round(crps, 5) AS mean_crps, round((c50 + c80 + c90 + c95 + c99) / 5, 5) AS mean_coverage_error,
 round(greatest(c50, c80, c90, c95, c99), 5) AS max_coverage_error, round((i95 + i90 + i80) / 3, 5) AS mean_interval_score FROM a""")
def calibration_metrics(spark, root):
    return _round_all(E.calibration(predictions(spark, root)))


@query("robustness_metrics", "EV-8", f"""WITH {PRED}, r AS (SELECT symbol, rn, k, y_true, y_pred, y_pred * (1 + ((rn * k) % 7 - 3) / 1000.0) AS y_new FROM pred, range(1, 6) t(k)),
pr AS (SELECT symbol, rn, var_pop(y_new) AS v, avg(y_new) AS m, max(y_new) - min(y_new) AS d, max(y_pred) AS y FROM r GROUP BY 1, 2),
a AS (SELECT symbol, avg(v) AS mean_pred_variance, avg(sqrt(v) / abs(m)) AS mean_pred_cv, avg(d) AS mean_max_diff, avg(d / abs(y)) AS relative_max_diff, 1 - avg(v / (y * y + 1e-10)) AS stability_score FROM pr GROUP BY 1),
pk AS (SELECT symbol, k, avg(CASE WHEN sign(y_new) = sign(y_pred) THEN 1.0 ELSE 0.0 END) AS c, sqrt(avg(pow(y_true - y_new, 2))) AS e, sqrt(avg(pow(y_true - y_pred, 2))) AS e0 FROM r GROUP BY 1, 2),
b AS (SELECT symbol, avg(c) AS direction_consistency, (avg(e) - max(e0)) / max(e0) AS rmse_degradation FROM pk GROUP BY 1)
SELECT symbol, round(mean_pred_variance, 5) AS mean_pred_variance, round(mean_pred_cv, 6) AS mean_pred_cv, round(mean_max_diff, 5) AS mean_max_diff, round(relative_max_diff, 6) AS relative_max_diff, round(stability_score, 6) AS stability_score,
 round(direction_consistency, 6) AS direction_consistency, round(rmse_degradation, 6) + 0.0 AS rmse_degradation FROM a JOIN b USING (symbol)""")
def robustness_metrics(spark, root):
    p = predictions(spark, root).withColumn("perturbation", F.explode(F.sequence(F.lit(1), F.lit(5))))
    runs = p.select("symbol", F.col("_rn").alias("row"), "perturbation", "y_true", "y_pred",
                    (F.col("y_pred") * (1.0 + ((F.col("_rn") * F.col("perturbation")) % 7 - 3) / 1000.0)).alias("y_new"))
    out = rounded(E.robustness(runs), ["mean_pred_variance", "mean_max_diff"], 5)
    return rounded(out, ["mean_pred_cv", "relative_max_diff", "stability_score", "direction_consistency", "rmse_degradation"])


@query("time_series_metrics", "EV-9", f"""WITH {PRED}, x AS (SELECT *, y_true - y_pred AS r, lag(y_true, 2) {_W} AS yh, lag(y_true) {_W} AS y1, lag(y_true - y_pred) {_W} AS r1, avg(y_true - y_pred) OVER (PARTITION BY symbol) AS mr FROM pred)
SELECT symbol, round(sqrt(avg(r * r)), 5) AS rmse, round(avg(abs(r)), 5) AS mae, round(avg(abs(r)) / avg(abs(y_true - yh)), 5) AS mase, round(sqrt(avg(r * r)) / (max(y_true) - min(y_true)), 5) AS nrmse,
 round(sqrt(sum(pow((y_pred - y1) / y1 - (y_true - y1) / y1, 2)) / sum(pow((y_true - y1) / y1, 2))), 5) AS theil_u2, round(sum((r - mr) * (r1 - mr)) / sum((r - mr) * (r - mr)), 5) AS residual_autocorr, round(avg(-r), 5) + 0.0 AS bias,
 round(avg(-r) / avg(y_true), 5) + 0.0 AS relative_bias, round(sum(r) / (count(*) * avg(abs(r))), 5) + 0.0 AS tracking_signal FROM x GROUP BY 1""")
def time_series_metrics(spark, root):
    return _round_all(E.time_series(predictions(spark, root), 2))


# registry: one entry per protocol (model) and day
_REG = HISTORY_SQL + """, reg AS (SELECT protocol AS model, CASE WHEN day(ts) % 2 = 0 THEN 'v2' ELSE 'v1' END AS version, 'events' AS dataset, CASE WHEN day(ts) % 3 = 0 THEN 'prod' ELSE 'test' END AS env, ts,
 tvl / transactions AS rmse, volume / transactions AS mae, users AS users, day(ts) % 5 = 0 AS fresh FROM ph)"""


def registry(spark, root):
    h = protocol_history(spark, root)
    d = F.dayofmonth("ts")
    return h.select(
        F.col("protocol").alias("model"), F.when(d % 2 == 0, "v2").otherwise("v1").alias("version"), F.lit("events").alias("dataset"),
        F.when(d % 3 == 0, "prod").otherwise("test").alias("env"), "ts",
        F.when(d % 5 == 0, F.array(F.lit("daily"), F.lit("fresh"))).otherwise(F.array(F.lit("daily"))).alias("tags"),
        F.create_map(F.lit("rmse"), F.col("tvl") / F.col("transactions"), F.lit("mae"), F.col("volume") / F.col("transactions"), F.lit("users"), F.col("users").cast("double")).alias("metrics"))


@query("metric_improvement", "EV-10", f"WITH {_REG}, x AS (SELECT model, arg_min(rmse, ts) AS b, arg_max(rmse, ts) AS v FROM reg GROUP BY 1) SELECT model, round((b - v) / abs(b) * 100, 5) AS improvement_pct FROM x")
def metric_improvement(spark, root):
    r = registry(spark, root).groupBy("model").agg(F.min_by(F.col("metrics")["rmse"], "ts").alias("baseline"), F.max_by(F.col("metrics")["rmse"], "ts").alias("value"))
    return _round_all(E.improvement(r))


@query("compare_models", "EV-11", f"WITH {_REG} SELECT model, max(ts) AS ts, count(*) AS entries, round(arg_max(rmse, ts), 5) AS rmse, round(arg_max(mae, ts), 5) AS mae FROM reg GROUP BY 1")
def compare_models(spark, root):
    return _round_all(E.compare_models(registry(spark, root), ["rmse", "mae"]))


@query("metric_evolution", "EV-12 FLT-13", f"WITH {_REG} SELECT model, ts, round(rmse, 5) AS rmse FROM reg WHERE env = 'test' AND fresh AND version = 'v1' AND ts >= TIMESTAMP '2024-01-05' ORDER BY model, ts")
def metric_evolution(spark, root):
    found = E.find_scores(registry(spark, root), version="v1", env="test", tags=["daily", "fresh"], since=F.lit("2024-01-05").cast("timestamp"))
    return found.select("model", "ts", rnd(F.col("metrics")["rmse"], 5).alias("rmse")).orderBy("model", "ts")


@query("degradation", "EV-13", f"""WITH {_REG}, k AS (SELECT model, rmse, row_number() OVER (PARTITION BY model ORDER BY ts DESC) AS r FROM reg), t AS (SELECT model, max(rmse) FILTER (r = 1) AS c, max(rmse) FILTER (r = 2) AS p FROM k WHERE r <= 2 GROUP BY 1)
SELECT model, round(c, 5) AS current, round(p, 5) AS previous, round((c - p) / abs(p), 5) AS relative_change, (c - p) / abs(p) > 0.1 AS degraded FROM t""")
def degradation(spark, root):
    return _round_all(E.degradation(registry(spark, root), "rmse"))


@query("best_model", "SRT-10", f"WITH {_REG}, c AS (SELECT model, round(arg_max(users, ts), 0) AS users, round(arg_max(rmse, ts), 5) AS rmse FROM reg GROUP BY 1) SELECT model, CAST(users AS DOUBLE) AS users, rmse FROM c ORDER BY users, rmse, model LIMIT 1")
def best_model(spark, root):
    c = _round_all(E.compare_models(registry(spark, root), ["users", "rmse"]).drop("ts", "entries"))
    return E.best_model(c, "users", ["rmse"])


_SIG = f"{PRED}, sg AS (SELECT symbol, ts, rn, (y_true - prev) / prev AS chg, CASE WHEN y_pred > prev * 1.1 THEN 1 WHEN y_pred < prev * 0.9 THEN -1 ELSE 0 END AS sig FROM pred)"


@query("signal_trading_metrics", "EV-14", f"""WITH {_SIG}, c AS (SELECT *, sum(sig * chg) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs FROM sg),
p AS (SELECT *, max(cs) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cs AS dd FROM c)
SELECT symbol, round(avg(CASE WHEN (sig = 1 AND chg > 0) OR (sig = -1 AND chg < 0) OR (sig = 0 AND abs(chg) < 0.01) THEN 1.0 ELSE 0.0 END), 5) AS signal_accuracy, round(sum(sig * chg), 4) AS total_return, round(avg(sig * chg) FILTER (sig <> 0), 5) AS mean_return_per_trade,
 round(avg(CASE WHEN sig * chg > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, round(avg(sig * chg) / (stddev_pop(sig * chg) + 1e-10) * sqrt(252), 5) AS sharpe_ratio, round(max(dd), 4) AS max_drawdown FROM p GROUP BY 1""")
def signal_trading_metrics(spark, root):
    p = predictions(spark, root)
    sig = F.when(F.col("y_pred") > F.col("prev") * 1.1, 1).when(F.col("y_pred") < F.col("prev") * 0.9, -1).otherwise(0)
    rows = p.select("symbol", "_rn", ((F.col("y_true") - F.col("prev")) / F.col("prev")).alias("change"), sig.alias("signal"))
    out = rounded(E.signal_scores(rows), ["total_return", "max_drawdown"], 4)
    return rounded(out, ["signal_accuracy", "mean_return_per_trade", "win_rate", "sharpe_ratio"], 5)


_CLS = "cl AS (SELECT CASE WHEN value > 60 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END AS actual, CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) > 66 THEN 2 WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) > 33 THEN 1 ELSE 0 END AS predicted FROM events)"


def _classes(spark, root):
    from ..functions.expr import json_num

    k = json_num("props", "$.k")
    return table(spark, root, "events").select(
        F.when(F.col("value") > 60, 2).when(F.col("value") > 20, 1).otherwise(0).alias("actual"), F.when(k > 66, 2).when(k > 33, 1).otherwise(0).alias("predicted"))


@query("classification_metrics", "EV-15", f"""WITH {_CLS}, s AS (SELECT l, (SELECT count(*) FROM cl WHERE actual = l) AS sup, (SELECT count(*) FROM cl WHERE predicted = l) AS cal, (SELECT count(*) FROM cl WHERE predicted = l AND actual = l) AS hit FROM range(0, 3) t(l)),
m AS (SELECT sup, hit, hit * 1.0 / cal AS p, hit * 1.0 / sup AS r FROM s) SELECT round(sum(hit) * 1.0 / sum(sup), 6) AS accuracy, round(sum(p * sup) / sum(sup), 6) AS "precision", round(sum(r * sup) / sum(sup), 6) AS recall, round(sum(2 * p * r / (p + r) * sup) / sum(sup), 6) AS f1 FROM m""")
def classification_metrics(spark, root):
    return _round_all(E.classification(_classes(spark, root), "actual", "predicted"), 6)


@query("confusion_matrix", "EV-15", f"WITH {_CLS} SELECT actual, predicted, count(*) AS n FROM cl GROUP BY 1, 2")
def confusion_matrix(spark, root):
    return E.confusion_matrix(_classes(spark, root), "actual", "predicted")


@query("roc_auc", "EV-15", """WITH c AS (SELECT event_type AS symbol, value AS score, CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 THEN 1 ELSE 0 END AS y FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY score) + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2.0 AS rk FROM c)
SELECT symbol, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY 1""")
def roc_auc(spark, root):
    from ..functions.expr import json_num

    rows = table(spark, root, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("score"), F.when(json_num("props", "$.k") > 50, 1).otherwise(0).alias("y"))
    return _round_all(E.roc_auc(rows, "symbol", "score", "y"), 6)


@query("batch_validation", "EV-16", f"""WITH {PRED}, x AS (SELECT *, sign(y_true - lag(y_true) {_W}) AS a, sign(y_pred - lag(y_pred) {_W}) AS b FROM pred)
SELECT symbol, round(avg(pow(y_true - y_pred, 2)), 4) AS mse, round(avg(abs(y_true - y_pred)), 5) AS mae, round(avg(CASE WHEN a IS NOT NULL THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END END), 5) AS direction_accuracy FROM x GROUP BY 1""")
def batch_validation(spark, root):
    return rounded(rounded(E.batch_validation(predictions(spark, root)), ["mse"], 4), ["mae", "direction_accuracy"], 5)


@query("drift_score", "EV-17", """WITH x AS (SELECT label % 2 AS side, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings), s AS (SELECT pos, avg(v::DOUBLE) FILTER (side = 0) AS mc, avg(v::DOUBLE) FILTER (side = 1) AS mr, stddev_pop(v::DOUBLE) FILTER (side = 1) AS sr FROM x GROUP BY 1)
SELECT round(tanh(avg(abs(mc - mr) / (sr + 1e-6))), 6) AS drift_score, round(max(abs(mc - mr) / (sr + 1e-6)), 6) AS max_shift, count(*) AS features FROM s""")
def drift_score(spark, root):
    e = table(spark, root, "embeddings")
    return _round_all(E.drift_score(e.filter("label % 2 = 0"), e.filter("label % 2 = 1"), "embedding"), 6)


@query("permutation_importance", "EV-18", f"""WITH {PRED}, l AS (SELECT symbol AS feature, rn % 5 AS repeat, avg(pow(y_true - y_pred, 2)) AS base_loss, avg(pow(y_true - y_pred, 2) + (rn % 11 - 4) * weight) AS loss FROM pred GROUP BY 1, 2),
i AS (SELECT feature, greatest(avg(loss - base_loss), 0) AS increase FROM l GROUP BY 1) SELECT feature, round(increase, 4) AS increase, round(coalesce(increase / nullif((SELECT max(increase) FROM i), 0), 0), 5) AS importance FROM i""")
def permutation_importance(spark, root):
    p = predictions(spark, root)
    sq = F.pow(F.col("y_true") - F.col("y_pred"), 2.0)
    losses = p.groupBy(F.col("symbol").alias("feature"), (F.col("_rn") % 5).alias("repeat")).agg(
        F.avg(sq).alias("base_loss"), F.avg(sq + (F.col("_rn") % 11 - 4) * F.col("weight")).alias("loss"))
    return rounded(rounded(E.permutation_importance(losses), ["increase"], 4), ["importance"], 5)


@query("ensemble_summary", "EV-19", f"WITH {_REG}, s AS (SELECT 'rmse' AS metric, rmse AS value FROM reg UNION ALL SELECT 'mae', mae FROM reg) SELECT metric, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, count(*) AS models FROM s GROUP BY 1")
def ensemble_summary(spark, root):
    s = registry(spark, root).select(F.explode(F.map_filter("metrics", lambda k, _: k != "users")).alias("metric", "value"))
    return _round_all(E.ensemble_summary(s))

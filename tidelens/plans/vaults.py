"""Vault, ledger and governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd, rounded
from ..operators import market as M
from ..operators import vaults as V
from ..sources import domain as D
from ..sources.tables import table
from .catalog import query

LED = D.LEDGER_SQL


@query("vault_flows", "AG-25", f"""WITH {LED} SELECT vault, CAST(coalesce(sum(amount) FILTER (kind = 'deposit'), 0) AS DOUBLE) AS deposits,
 CAST(coalesce(sum(amount) FILTER (kind = 'withdrawal'), 0) AS DOUBLE) AS withdrawals, CAST(coalesce(sum(amount) FILTER (kind = 'fee'), 0) AS DOUBLE) AS fees FROM led GROUP BY 1""")
def vault_flows(spark, root):
    return V.flow_totals(D.ledger(spark, root), "vault")


@query("vault_balance", "AG-26", f"""WITH RECURSIVE {LED}, o AS (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY ts, tx) AS rn,
 CASE kind WHEN 'deposit' THEN amount WHEN 'withdrawal' THEN -amount ELSE 0 END AS d FROM led),
r AS (SELECT vault, rn, CAST(greatest(d, 0) AS DECIMAL(28,2)) AS b FROM o WHERE rn = 1
 UNION ALL SELECT o.vault, o.rn, CAST(greatest(r.b + o.d, 0) AS DECIMAL(28,2)) FROM r JOIN o ON o.vault = r.vault AND o.rn = r.rn + 1)
SELECT o.tx, o.vault, o."user", o.kind, CAST(o.amount AS DOUBLE) AS amount, o.ts, CAST(r.b AS DOUBLE) AS balance FROM o JOIN r USING (vault, rn)""")
def vault_balance(spark, root):
    b = V.running_balance(D.ledger(spark, root))
    return b.select("tx", "vault", "user", "kind", F.col("amount").cast("double").alias("amount"), "ts", "balance")


@query("user_first_last_seen", "AG-27 SM-7", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def user_first_last_seen(spark, root):
    return table(spark, root, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("trade_status", "AG-28", "SELECT event_id, CASE WHEN value > 40 THEN 'profit' WHEN value < 40 THEN 'loss' ELSE 'neutral' END AS status FROM events WHERE event_type = 'purchase'")
def trade_status(spark, root):
    r = F.col("value") - 40
    return table(spark, root, "events").filter("event_type = 'purchase'").select(
        "event_id", F.when(r > 0, "profit").when(r < 0, "loss").otherwise("neutral").alias("status"))


@query("win_rate", "AG-29", "SELECT user_id AS model, count(*) AS trades, round(100.0 * count(*) FILTER (value > 40) / count(*), 2) AS win_rate FROM events WHERE event_type = 'purchase' GROUP BY 1")
def win_rate(spark, root):
    p = table(spark, root, "events").filter("event_type = 'purchase'")
    return p.groupBy(F.col("user_id").alias("model")).agg(
        F.count(F.lit(1)).alias("trades"), rnd(100.0 * F.count_if(F.col("value") > 40) / F.count(F.lit(1)), 2).alias("win_rate"))


_FLOWS = f"""{LED}, fl AS (SELECT vault, "user", CAST(sum(amount) FILTER (kind = 'deposit') AS DOUBLE) AS amount, min(ts) FILTER (kind = 'deposit') AS joined,
  max(ts) FILTER (kind = 'withdrawal') AS w, max(ts) FILTER (kind = 'deposit') AS dl FROM led GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'deposit') > 0),
 f2 AS (SELECT vault, "user", amount, joined, CASE WHEN w > dl THEN w END AS exited FROM fl)"""


@query("participant_stats", "AG-30", f"""WITH {_FLOWS} SELECT vault, count(*) AS total, count(*) FILTER (exited IS NULL) AS active, round(sum(amount), 2) AS deposits, round(avg(amount), 4) AS mean_size,
 round(count(*) FILTER (exited IS NULL) * 1.0 / count(*), 6) AS retention_rate, round(avg(date_diff('day', joined, coalesce(exited, (SELECT max(o_orderdate) FROM orders)))), 4) AS mean_holding_days FROM f2 GROUP BY 1""")
def participant_stats(spark, root):
    led = D.ledger(spark, root)
    dep, wd = F.col("kind") == "deposit", F.col("kind") == "withdrawal"
    fl = led.groupBy("vault", "user").agg(
        F.sum(F.when(dep, F.col("amount"))).cast("double").alias("amount"), F.min(F.when(dep, F.col("ts"))).alias("joined"),
        F.max(F.when(wd, F.col("ts"))).alias("w"), F.max(F.when(dep, F.col("ts"))).alias("dl")).filter("joined IS NOT NULL")
    fl = fl.withColumn("exited", F.when(F.col("w") > F.col("dl"), F.col("w")))
    out = V.participant_stats(fl, M.newest(led))
    return rounded(rounded(rounded(out, ["deposits"], 2), ["mean_size", "mean_holding_days"], 4), ["retention_rate"])


@query("vault_stats", "AG-31", f"""WITH {LED} SELECT vault, count(*) FILTER (kind = 'deposit') AS deposit_count, round(avg(CAST(amount AS DOUBLE)) FILTER (kind = 'deposit'), 4) AS deposit_mean,
 count(*) FILTER (kind = 'withdrawal') AS withdrawal_count, round(avg(CAST(amount AS DOUBLE)) FILTER (kind = 'withdrawal'), 4) AS withdrawal_mean,
 arg_max(tx, (ts, tx)) FILTER (kind = 'deposit') AS last_deposit, arg_max(tx, (ts, tx)) FILTER (kind = 'withdrawal') AS last_withdrawal FROM led GROUP BY 1""")
def vault_stats(spark, root):
    return rounded(V.activity_stats(D.ledger(spark, root)), ["deposit_mean", "withdrawal_mean"], 4)


@query("top_assets", "AG-31 SRT-6", f"""WITH {D.ALLOCATIONS_SQL} SELECT portfolio, asset, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY amount DESC, asset) AS rk FROM am) WHERE rk <= 3""")
def top_assets(spark, root):
    from pyspark.sql import Window

    w = Window.partitionBy("portfolio").orderBy(F.col("weight").desc(), "asset")
    return D.allocations(spark, root).withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("portfolio", "asset", "rk")


_NAV = f"""{LED}, nav AS (SELECT vault, ts, CAST(sum(amount) AS DOUBLE) AS nav FROM led GROUP BY 1, 2), nw AS (SELECT max(ts) AS now FROM nav)"""


def _nav(spark, root):
    return D.ledger(spark, root).groupBy("vault", "ts").agg(F.sum("amount").cast("double").alias("nav"))


_PERIODS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90, "yearly": 365}


@query("nav_returns", "AG-33 JN-4", f"WITH {_NAV}, c AS (SELECT vault, arg_max(nav, ts) AS nav, arg_min(nav, ts) AS b_inception, " + ", ".join(
    f"arg_max(nav, ts) FILTER (ts <= now - INTERVAL {d} DAY) AS b_{n}" for n, d in _PERIODS.items()) + " FROM nav, nw GROUP BY 1) SELECT vault, nav, " + ", ".join(
    f"CAST(floor(10000.0 * (nav - b_{n}) / nullif(b_{n}, 0)) AS BIGINT) AS {n}_bps" for n in [*_PERIODS, "inception"]) + " FROM c")
def nav_returns(spark, root):
    nav = _nav(spark, root)
    return V.nav_returns(nav, M.newest(nav))


@query("vault_fees", "PF-28 PF-32", f"""WITH {_NAV}, m AS (SELECT vault, ts, nav, max(nav) OVER (PARTITION BY vault ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hwm,
 max(nav) OVER (PARTITION BY vault ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM nav)
SELECT vault, ts, nav, hwm AS high_water_mark, round(greatest(nav - coalesce(pm, nav), 0) * 0.2, 6) AS performance_fee, round(nav * 50 / 10000, 6) AS entry_fee, round(nav * 100 / 10000, 6) AS exit_fee FROM m""")
def vault_fees(spark, root):
    nav = _nav(spark, root).withColumn("amount", F.col("nav"))
    return rounded(V.fees(nav), ["performance_fee", "entry_fee", "exit_fee"])


@query("user_vault_position", "PF-24", f"""WITH {_NAV}, s AS (SELECT vault, "user", count(*) AS shares FROM led GROUP BY 1, 2), l AS (SELECT vault, arg_max(nav, ts) AS nav FROM nav GROUP BY 1)
SELECT s.vault, s."user", s.shares, round(s.shares * l.nav, 4) AS value FROM s JOIN l USING (vault)""")
def user_vault_position(spark, root):
    shares = D.ledger(spark, root).groupBy("vault", "user").agg(F.count(F.lit(1)).alias("shares"))
    return rounded(V.user_positions(shares, _nav(spark, root)), ["value"], 4)


@query("simple_apy", "PF-29", f"""WITH {D.VALUES_SQL}, v AS (SELECT portfolio AS symbol, arg_min(value, ts) AS s, arg_max(value, ts) AS e, date_diff('day', min(ts), max(ts)) AS days FROM pv GROUP BY 1)
SELECT symbol, CAST(days AS INTEGER) AS days, round((e - s) / s * 100, 6) AS profit_pct, round((e - s) / s * 100 * 365.0 / days, 6) AS apy FROM v""")
def simple_apy(spark, root):
    return rounded(V.simple_apy(D.portfolio_values(spark, root).withColumnRenamed("portfolio", "symbol")), ["profit_pct", "apy"])


_VOTES = """vt AS (SELECT event_id AS vote_id, user_id % 12 AS proposal, user_id AS voter, ts, CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'yes' WHEN 'purchase' THEN 'no' WHEN 'signup' THEN 'abstain'
  ELSE CASE WHEN user_id % 5 = 0 THEN 'veto' ELSE 'no' END END AS choice, CAST(floor(value * 100) AS BIGINT) AS tokens, event_id % 700 * 86400 AS lock_seconds FROM events)"""
_TALLY = """f AS (SELECT proposal, voter, arg_min(choice, (ts, vote_id)) AS choice, arg_min(power, (ts, vote_id)) AS power, max(supply) AS supply FROM vp GROUP BY 1, 2),
t AS (SELECT proposal, coalesce(sum(power) FILTER (choice = 'yes'), 0) AS yes, coalesce(sum(power) FILTER (choice = 'no'), 0) AS "no", coalesce(sum(power) FILTER (choice = 'abstain'), 0) AS abstain,
 coalesce(sum(power) FILTER (choice = 'veto'), 0) AS veto, max(supply) AS supply FROM f GROUP BY 1)"""


def _votes(spark, root):
    ev = table(spark, root, "events")
    k = F.col("event_type")
    choice = (F.when(k.isin("click", "view"), "yes").when(k == "purchase", "no").when(k == "signup", "abstain")
              .otherwise(F.when(F.col("user_id") % 5 == 0, "veto").otherwise("no")))
    return ev.select(F.col("event_id").alias("vote_id"), (F.col("user_id") % 12).alias("proposal"), F.col("user_id").alias("voter"), "ts",
                     choice.alias("choice"), F.floor(F.col("value") * 100).alias("tokens"), (F.col("event_id") % 700 * 86400).alias("lock_seconds"))


for _basis, _den in (("yes_no", 'yes + "no"'), ("supply", "supply"), ("votes", 'yes + "no" + abstain')):
    @query(f"vote_tally_{_basis}", "AG-37 AG-38 AG-44 SET-3", f"""WITH {_VOTES}, vp AS (SELECT *, CAST(floor(tokens * (1.0::DOUBLE + lock_seconds / (365.0::DOUBLE * 86400.0))) AS BIGINT) AS power, 60000 AS supply FROM vt), {_TALLY}
SELECT proposal, CAST(yes AS BIGINT) AS yes, CAST("no" AS BIGINT) AS "no", CAST(abstain AS BIGINT) AS abstain, CAST(veto AS BIGINT) AS veto,
 veto = 0 AND yes + "no" + abstain >= supply * 20 // 100 AS quorum_achieved,
 veto = 0 AND yes + "no" + abstain >= supply * 20 // 100 AND coalesce(yes * 100 // nullif({_den}, 0) >= 50, FALSE) AS threshold_achieved,
 round(CAST(yes + "no" + abstain AS DOUBLE) / supply * 100, 6) AS participation_pct FROM t""")
    def _vote_tally(spark, root, basis=_basis):
        v = _votes(spark, root).withColumns({
            "power": V.cast_power(F.col("tokens"), F.col("lock_seconds")), "supply": F.lit(60000).cast("long")})
        return rounded(V.tally(v, basis=basis), ["participation_pct"])


@query("voting_power", "AG-39", f"""WITH {_VOTES} SELECT vote_id, CAST(floor(tokens * (1.0::DOUBLE + 1.0 * least(lock_seconds, 31536000) / 31536000.0::DOUBLE)) AS BIGINT) AS time_weighted,
 CAST(floor(sqrt(tokens)) AS BIGINT) AS quadratic FROM vt""")
def voting_power(spark, root):
    return _votes(spark, root).select("vote_id", V.time_weighted_power(F.col("tokens"), F.col("lock_seconds")).alias("time_weighted"),
                                      V.quadratic_power(F.col("tokens")).alias("quadratic"))

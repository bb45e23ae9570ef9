"""Market queries: joins, protocol and token roll-ups, correlations, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import div, json_num, rnd, rounded
from ..operators import joins as J
from ..operators import market as M
from ..sources import bars as B
from ..sources import domain as D
from ..sources.tables import table
from .catalog import query

PE, PH, POS, LED = D.PROTOCOL_EVENTS_SQL, D.HISTORY_SQL, D.POSITIONS_SQL, D.LEDGER_SQL
DAY_AGO = "(SELECT max(ts) FROM events) - INTERVAL 24 HOUR"


@query("protocol_tvl", "AG-1 FLT-7", f"WITH {POS} SELECT protocol, CAST(sum(CASE WHEN active THEN value END) AS DOUBLE) AS tvl FROM pos GROUP BY 1")
def protocol_tvl(spark, root):
    return M.tvl(D.positions(spark, root))


@query("day_activity", "AG-2 AG-3 AG-4 AG-5 FLT-8", f"""WITH {PE}
SELECT protocol, coalesce(sum(CASE WHEN kind IN ('swap','add_liquidity','remove_liquidity') THEN k END), 0.0) AS volume_24h,
       coalesce(sum(CASE WHEN kind = 'fee_collection' THEN k END), 0.0) AS fees_24h, count(*) AS transactions_24h,
       count(DISTINCT "user") AS users_24h
FROM pe WHERE ts >= {DAY_AGO} GROUP BY 1""")
def day_activity(spark, root):
    ev = D.protocol_events(spark, root)
    return M.day_activity(ev, M.newest(ev))


_RISK_SQL = """
lastn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY ts DESC) AS rk FROM ph) WHERE rk <= 30),
rets AS (SELECT protocol, tvl, CASE WHEN pt IS NULL THEN NULL WHEN pt = 0 THEN 0 ELSE (tvl - pt) / pt END AS ret
         FROM (SELECT *, lag(tvl) OVER (PARTITION BY protocol ORDER BY ts) AS pt FROM lastn)),
vols AS (SELECT protocol, count(*) AS points, stddev_samp(ret) AS vol FROM rets GROUP BY 1),
risk AS (SELECT u.protocol, least(coalesce(CASE WHEN points >= 10 THEN least(vol * 10, 30) END, 0) + CASE WHEN u.n < 100 THEN 20 ELSE 0 END + 10, 100) AS risk_score
         FROM (SELECT protocol, count(DISTINCT "user") AS n FROM pe GROUP BY 1) u LEFT JOIN vols USING (protocol))"""
_GROWTH_SQL = """
cur AS (SELECT protocol, arg_max(tvl, ts) AS v FROM ph GROUP BY 1),
old AS (SELECT protocol, arg_max(tvl, ts) AS v FROM ph WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1),
gr AS (SELECT cur.protocol, coalesce((cur.v - old.v) / nullif(old.v, 0) * 100, 0) AS growth FROM cur LEFT JOIN old USING (protocol))"""


@query("protocol_metrics", "AG-6 AG-10 AG-11 AG-13 JN-3 JN-4 SRT-4", f"""WITH {PH}, {_RISK_SQL}, {_GROWTH_SQL},
act AS (SELECT protocol, coalesce(sum(CASE WHEN kind IN ('swap','add_liquidity','remove_liquidity') THEN k END), 0.0) AS volume_24h,
       coalesce(sum(CASE WHEN kind = 'fee_collection' THEN k END), 0.0) AS fees_24h, count(*) AS transactions_24h,
       count(DISTINCT "user") AS users_24h FROM pe WHERE ts >= {DAY_AGO} GROUP BY 1)
SELECT t.protocol, t.tvl, coalesce(volume_24h, 0.0) AS volume_24h, coalesce(fees_24h, 0.0) AS fees_24h, coalesce(transactions_24h, 0) AS transactions_24h,
       coalesce(users_24h, 0) AS users_24h, round(growth, 6) AS growth, round(risk_score, 6) AS risk_score
FROM (SELECT protocol, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS tvl FROM pe GROUP BY 1) t LEFT JOIN act USING (protocol)
LEFT JOIN gr USING (protocol) LEFT JOIN risk USING (protocol)""")
def protocol_metrics(spark, root):
    return rounded(M.protocol_metrics(D.protocol_events(spark, root), D.protocol_history(spark, root)), ["growth", "risk_score"])


@query("market_totals", "AG-7 AG-8 AG-9 JN-3", f"""WITH {PH}, l AS (SELECT protocol, arg_max(tvl, ts) AS tvl, arg_max(volume, ts) AS volume FROM ph GROUP BY 1)
SELECT round(sum(tvl), 4) AS total_tvl, sum(volume) AS total_volume, round(max(tvl) / sum(tvl) * 100, 6) AS dominance_index,
       round(least(sum(volume) / sum(tvl) * 100, 100), 6) AS liquidity_index, count(*) AS protocols FROM l""")
def market_totals(spark, root):
    df = M.market_totals(D.protocol_history(spark, root))
    return rounded(rounded(df, ["total_tvl"], 4), ["dominance_index", "liquidity_index"])


@query("volatility_index", "AG-11 AG-12 SRT-4", f"WITH {PH}, {_RISK_SQL} SELECT round(avg(vol), 6) AS volatility_index, count(*) AS series FROM vols WHERE points >= 10")
def volatility_index(spark, root):
    return rounded(M.volatility_index(D.protocol_history(spark, root), "protocol", "tvl"), ["volatility_index"])


@query("growth_against_day_ago", "AG-20 JN-4", f"""WITH {PH}, c AS (SELECT protocol, arg_max(tvl, ts) AS a, arg_max(volume, ts) AS b, arg_max(users, ts) AS d FROM ph GROUP BY 1),
o AS (SELECT protocol, arg_max(tvl, ts) AS a, arg_max(volume, ts) AS b, arg_max(users, ts) AS d FROM ph WHERE ts <= {DAY_AGO} GROUP BY 1)
SELECT c.protocol, round(coalesce((c.a - o.a) / nullif(o.a, 0) * 100, 0), 6) AS tvl_growth, round(coalesce((c.b - o.b) / nullif(o.b, 0) * 100, 0), 6) AS volume_growth,
       round(coalesce((c.d - o.d) / nullif(o.d, 0) * 100.0, 0), 6) AS user_growth FROM c LEFT JOIN o USING (protocol)""")
def growth_against_day_ago(spark, root):
    h = D.protocol_history(spark, root)
    now = M.newest(D.protocol_events(spark, root))
    out = None
    for measure, name in (("tvl", "tvl_growth"), ("volume", "volume_growth"), ("users", "user_growth")):
        g = M.growth(h, "protocol", measure, now, "24 HOURS").select("protocol", rnd("growth").alias(name))
        out = g if out is None else out.join(g, "protocol")
    return out


_TICKS = "tk AS (SELECT event_type AS symbol, ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"


@query("token_metrics", "AG-14 AG-15 AG-16 JN-4", f"""WITH {_TICKS}, n AS (SELECT max(ts) AS now FROM events),
b AS (SELECT symbol, arg_max(price, (ts, event_id)) AS price, sum(CASE WHEN ts >= now - INTERVAL 24 HOUR THEN volume * price END) AS volume_24h FROM tk, n GROUP BY 1),
o AS (SELECT symbol, arg_max(price, (ts, event_id)) AS price_24h_ago FROM tk, n WHERE ts <= now - INTERVAL 24 HOUR GROUP BY 1),
h AS (SELECT symbol, date_trunc('hour', ts) AS h, arg_max(price, (ts, event_id)) AS p FROM tk, n WHERE ts >= now - INTERVAL 7 DAY GROUP BY 1, 2),
r AS (SELECT symbol, stddev_samp(CASE WHEN q = 0 THEN 0 ELSE (p - q) / q END) AS volatility_7d FROM (SELECT *, lag(p) OVER (PARTITION BY symbol ORDER BY h) AS q FROM h) WHERE q IS NOT NULL GROUP BY 1)
SELECT symbol, price, price_24h_ago, round(volume_24h, 4) AS volume_24h, round(volatility_7d, 5) AS volatility_7d,
       round((price - price_24h_ago) / price_24h_ago * 100, 5) AS change_24h FROM b LEFT JOIN o USING (symbol) LEFT JOIN r USING (symbol)""")
def token_metrics(spark, root):
    t = B.event_ticks(spark, root)
    return rounded(rounded(M.token_metrics(t, M.newest(t)), ["volume_24h"], 4), ["volatility_7d", "change_24h"], 5)


_CORR_SQL = f"""WITH {PH}, lastn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY ts DESC) AS rk FROM ph) WHERE rk <= 30)
SELECT a.protocol AS "left", b.protocol AS "right", count(*) AS points, round(coalesce(corr(a.tvl, b.tvl), 0), 6) AS correlation
FROM lastn a JOIN lastn b ON a.rk = b.rk AND a.protocol < b.protocol GROUP BY 1, 2 HAVING count(*) >= 10"""


@query("protocol_correlation", "JN-11 AG-17 AG-18", _CORR_SQL)
def protocol_correlation(spark, root):
    last = M.recent(D.protocol_history(spark, root), "protocol", 30)
    return rounded(M.correlation_pairs(last, "protocol", "rank", "tvl"), ["correlation"])


@query("market_share", "AG-19 AG-24", f"WITH {POS}, t AS (SELECT protocol, CAST(sum(CASE WHEN active THEN value END) AS DOUBLE) AS tvl FROM pos GROUP BY 1) SELECT protocol, tvl, round(tvl / (SELECT sum(tvl) FROM t) * 100, 6) AS share FROM t")
def market_share(spark, root):
    return rounded(M.market_share(M.tvl(D.positions(spark, root))), ["share"])


@query("pool_liquidity", "AG-21", f"""WITH {POS}, p AS (SELECT protocol, pool, sum(value) AS v FROM pos WHERE active GROUP BY 1, 2)
SELECT protocol, CAST(sum(v) AS DOUBLE) AS total_liquidity, count(*) AS pools, round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS average_depth FROM p GROUP BY 1""")
def pool_liquidity(spark, root):
    return rounded(M.pool_liquidity(D.positions(spark, root)), ["average_depth"], 4)


@query("yield_rollup", "AG-22 FN-8", f"""WITH {POS} SELECT portfolio, round(sum(quantity * apy), 4) AS total_yield, round(sum(apy * value / 100), 4) AS weighted_apy,
 round(sum(farming), 4) AS farming_rewards, sum(quantity) AS staking_rewards FROM pos WHERE active GROUP BY 1""")
def yield_rollup(spark, root):
    return rounded(M.yield_rollup(D.positions(spark, root)), ["total_yield", "weighted_apy", "farming_rewards"], 4)


@query("asset_allocation", "AG-24", f"""WITH {POS}, a AS (SELECT portfolio, protocol, sum(value) AS v FROM pos WHERE active GROUP BY 1, 2)
SELECT portfolio, protocol, CAST(v AS DOUBLE) AS value, round(100.0 * CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY portfolio) AS DOUBLE), 6) AS share FROM a""")
def asset_allocation(spark, root):
    a = D.positions(spark, root).filter("active").groupBy("portfolio", "protocol").agg(F.sum("value").alias("v"))
    t = a.groupBy("portfolio").agg(F.sum("v").alias("t"))
    return a.join(t, "portfolio").select("portfolio", "protocol", F.col("v").cast("double").alias("value"),
                                         rnd(100.0 * div("v", "t")).alias("share"))


@query("alert_metrics", "AG-23", f"""WITH a AS (SELECT event_id, user_id % 50 AS owner, event_type, ts, value > 80 AS fired, value > 20 AS active FROM events),
r AS (SELECT owner, list(event_id ORDER BY ts DESC, event_id DESC) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, event_id DESC) AS rn FROM a) WHERE rn <= 10 GROUP BY 1)
SELECT owner, count(*) AS total_alerts, count(*) FILTER (fired) AS triggered_alerts, count(*) FILTER (active) AS active_alerts,
       count(*) FILTER (event_type = 'click') AS type_click, count(*) FILTER (event_type = 'error') AS type_error, count(*) FILTER (event_type = 'purchase') AS type_purchase,
       count(*) FILTER (event_type = 'signup') AS type_signup, count(*) FILTER (event_type = 'view') AS type_view, array_to_string(any_value(ids), ',') AS recent
FROM a JOIN r USING (owner) GROUP BY 1""")
def alert_metrics(spark, root):
    from pyspark.sql import Window

    ev = table(spark, root, "events").withColumn("owner", F.col("user_id") % 50)
    totals = ev.groupBy("owner").agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if(F.col("value") > 80).alias("triggered_alerts"),
        F.count_if(F.col("value") > 20).alias("active_alerts"),
        *[F.count_if(F.col("event_type") == t).alias(f"type_{t}") for t in ("click", "error", "purchase", "signup", "view")])
    w = Window.partitionBy("owner").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = ev.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy("owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("recent"))
    return totals.join(last, "owner")


@query("distinct_protocols", "AG-40 SET-2", f"WITH {PE} SELECT DISTINCT protocol, kind FROM pe")
def distinct_protocols(spark, root):
    return D.protocol_events(spark, root).select("protocol", "kind").distinct()


@query("average_daily_volume", "AG-36", f"WITH {_TICKS} SELECT symbol, round(avg(v), 4) AS average_daily_volume FROM (SELECT symbol, CAST(ts AS DATE) AS d, sum(volume) AS v FROM tk GROUP BY 1, 2) GROUP BY 1")
def average_daily_volume(spark, root):
    t = B.event_ticks(spark, root)
    d = t.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.sum("volume").alias("v"))
    return d.groupBy("symbol").agg(rnd(F.avg("v"), 4).alias("average_daily_volume"))


_BARS = """SELECT event_type AS symbol, time_bucket(INTERVAL '{w}', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume FROM events GROUP BY 1, 2"""


@query("ohlcv_bars", "AG-42", _BARS.format(w="1 hour"))
def ohlcv_bars(spark, root):
    return B.event_bars(spark, root, "1h")


@query("resample_bars", "AG-43 FN-3", _BARS.format(w="1 day"))
def resample_bars(spark, root):
    return B.resample(B.resample(B.event_bars(spark, root, "1h"), "4h"), "1d")


@query("latest_metrics", "JN-3", f"WITH {PH} SELECT protocol, max(ts) AS ts, arg_max(tvl, ts) AS tvl, arg_max(users, ts) AS users FROM ph GROUP BY 1")
def latest_metrics(spark, root):
    return J.latest(D.protocol_history(spark, root).select("protocol", "ts", "tvl", "users"), ["protocol"], ["ts"])


@query("asof_price", "JN-4", f"""WITH {_TICKS}, p AS (SELECT event_id, ts, event_type AS symbol FROM events WHERE event_type <> 'error'),
s AS (SELECT 'click' AS symbol, ts, price FROM tk WHERE symbol = 'error' UNION ALL SELECT 'view', ts, price FROM tk WHERE symbol = 'error'
      UNION ALL SELECT 'signup', ts, price FROM tk WHERE symbol = 'error' UNION ALL SELECT 'purchase', ts, price FROM tk WHERE symbol = 'error')
SELECT p.event_id, p.symbol, p.ts, s.price FROM p ASOF LEFT JOIN s ON p.symbol = s.symbol AND p.ts >= s.ts""")
def asof_price(spark, root):
    t = B.event_ticks(spark, root)
    probes = t.filter("symbol <> 'error'").select(F.col("tie").alias("event_id"), "symbol", "ts")
    quotes = t.filter("symbol = 'error'").select(
        F.explode(F.array(*[F.lit(s) for s in ("click", "view", "signup", "purchase")])).alias("symbol"), "ts", "price")
    return J.asof(probes, quotes, "symbol", "ts", ["price"])


@query("side_series_join", "JN-1 SRC-2 SRC-8", """WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max(value) AS high FROM events GROUP BY 1, 2),
s AS (SELECT event_type AS symbol, date_trunc('hour', ts) + INTERVAL 1 DAY AS ts, round(avg(value), 6) AS score, count(*) AS posts FROM events GROUP BY 1, 2)
SELECT b.symbol, b.ts, b.high, s.score AS sentiment_score, s.posts AS sentiment_posts FROM b LEFT JOIN s USING (symbol, ts)""")
def side_series_join(spark, root):
    ev = table(spark, root, "events")
    keys = [F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")]
    base = ev.groupBy(*keys).agg(F.max("value").alias("high"))
    # the day before is the side series: hours without events then, and the whole first day, lack it
    before = [keys[0], (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 DAY")).alias("ts")]
    side = ev.groupBy(*before).agg(rnd(F.avg("value")).alias("score"), F.count(F.lit(1)).alias("posts"))
    return J.attach(base, {"sentiment": side}, ["symbol", "ts"])


@query("multi_source_outer_join", "JN-2 DP-31", """WITH a AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max(value) AS price FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min(value) AS price FROM events WHERE user_id % 2 = 1 GROUP BY 1, 2),
j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, a.price, b.price AS price_b FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts),
f AS (SELECT symbol, ts, last_value(price IGNORE NULLS) OVER w AS p1, first_value(price IGNORE NULLS) OVER v AS p2, last_value(price_b IGNORE NULLS) OVER w AS q1, first_value(price_b IGNORE NULLS) OVER v AS q2
 FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, ts, coalesce(p1, p2) AS price, coalesce(q1, q2) AS price_b FROM f""")
def multi_source_outer_join(spark, root):
    from ..operators.quality import fill_both

    ev = table(spark, root, "events")
    keys = [F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")]
    a = ev.filter("user_id % 2 = 0").groupBy(*keys).agg(F.max("value").alias("price"))
    b = ev.filter("user_id % 2 = 1").groupBy(*keys).agg(F.min("value").alias("price"))
    j = J.outer_merge({"a": a, "b": b}, ["symbol", "ts"])
    return fill_both(B.numbered(j), ["price", "price_b"]).drop("_rn")


@query("signal_trade_join", "JN-5 JN-6 AG-28", """WITH s AS (SELECT user_id AS model_id, event_id % 40 AS signal_id, min(ts) AS submitted FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
t AS (SELECT user_id AS model_id, event_id % 40 AS signal_id, event_id, value - 40 AS result FROM events WHERE event_type = 'purchase'),
m AS (SELECT c_custkey AS model_id, c_name FROM customer)
SELECT coalesce(s.model_id, t.model_id) AS model_id, coalesce(s.signal_id, t.signal_id) AS signal_id, s.submitted, t.event_id, s.model_id IS NULL AS placeholder,
 CASE WHEN result > 0 THEN 'profit' WHEN result < 0 THEN 'loss' WHEN result = 0 THEN 'neutral' END AS status, m.c_name AS model
FROM s FULL JOIN t ON s.model_id = t.model_id AND s.signal_id = t.signal_id LEFT JOIN m ON m.model_id = coalesce(s.model_id, t.model_id)""")
def signal_trade_join(spark, root):
    ev = table(spark, root, "events").withColumns({"model_id": F.col("user_id"), "signal_id": F.col("event_id") % 40})
    s = ev.filter("event_type = 'signup'").groupBy("model_id", "signal_id").agg(F.min("ts").alias("submitted"))
    t = ev.filter("event_type = 'purchase'").select("model_id", "signal_id", "event_id", (F.col("value") - 40).alias("result"))
    m = table(spark, root, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_name").alias("model"))
    status = F.when(F.col("result") > 0, "profit").when(F.col("result") < 0, "loss").when(F.col("result") == 0, "neutral")
    j = s.withColumn("_s", F.lit(True)).join(t, ["model_id", "signal_id"], "full_outer")
    return j.join(m, "model_id", "left").select(
        "model_id", "signal_id", "submitted", "event_id", F.col("_s").isNull().alias("placeholder"), status.alias("status"), "model")


@query("transfer_to_vault", "JN-7", """WITH f AS (SELECT l_orderkey AS tx, l_linenumber AS line, l_suppkey AS source, l_partkey AS destination, l_extendedprice AS amount FROM lineitem),
v AS (SELECT s_suppkey AS k FROM supplier)
SELECT tx, line, source, destination, amount, source AS owner, 'source' AS side FROM f JOIN v ON source = k
UNION ALL SELECT tx, line, source, destination, amount, destination, 'destination' FROM f JOIN v ON destination = k""")
def transfer_to_vault(spark, root):
    f = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source"),
        F.col("l_partkey").alias("destination"), F.col("l_extendedprice").alias("amount"))
    v = table(spark, root, "supplier").select(F.col("s_suppkey").alias("k"))
    return J.touch_either(f, "source", "destination", v, "k")


@query("new_rows", "JN-8", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def new_rows(spark, root):
    od = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    li = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return od.join(li, "o_orderkey", "left_anti")


@query("get_or_create_users", "JN-9", """SELECT c_custkey AS user_id, c_name AS name, FALSE AS created FROM customer
UNION ALL SELECT DISTINCT user_id, 'user-' || user_id, TRUE FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def get_or_create_users(spark, root):
    known = table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    seen = table(spark, root, "events").select("user_id").distinct()
    fresh = seen.join(known, "user_id", "left_anti").select("user_id", F.concat(F.lit("user-"), "user_id").alias("name"))
    return known.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


@query("mention_match", "JN-10", f"WITH {D.POSTS_SQL} SELECT post_id, platform FROM posts WHERE list_contains(protocols, 'p3')")
def mention_match(spark, root):
    return D.posts(spark, root).filter(F.array_contains("protocols", "p3")).select("post_id", "platform")


@query("foreign_key_audit", "JN-14", """SELECT 'lineitem.part' AS "key", count(*) AS orphan_rows, count(DISTINCT l_partkey) AS orphan_keys FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orders.customer', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.orders', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'events.customer', count(*), count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def foreign_key_audit(spark, root):
    t = lambda n: table(spark, root, n)
    parts = [("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"),
             ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey")]
    out = None
    for child, fk, parent, pk in parts:
        a = J.orphans(t(child), fk, t(parent), pk, f"{child}.{parent}")
        out = a if out is None else out.unionByName(a)
    return out


@query("whale_movements", "SRT-6 AG-15", f"WITH {LED} SELECT tx, vault, CAST(amount AS DOUBLE) AS amount FROM led WHERE amount >= 400000 ORDER BY amount DESC, tx LIMIT 25")
def whale_movements(spark, root):
    led = D.ledger(spark, root).select("tx", "vault", F.col("amount").cast("double").alias("amount"))
    return M.whale_transfers(led, "amount", 400000.0, 25)


@query("trend_frames", "PF-30", " UNION ALL ".join(
    f"SELECT '{tf}' AS timeframe, protocol, count(*) AS points, arg_min(tvl, ts) AS \"first\", arg_max(tvl, ts) AS \"last\", round((arg_max(tvl, ts) - arg_min(tvl, ts)) / arg_min(tvl, ts) * 100, 6) AS change_pct FROM (WITH {PH} SELECT * FROM ph) WHERE ts >= (SELECT max(date_trunc('day', ts)) FROM events) - INTERVAL {iv} GROUP BY 2"
    for tf, iv in (("1h", "1 HOUR"), ("1d", "1 DAY"), ("7d", "7 DAY"), ("30d", "30 DAY"))))
def trend_frames(spark, root):
    out = None
    for tf in ("1h", "1d", "7d", "30d"):
        a = M.trend_frame(D.protocol_history(spark, root), "protocol", "tvl", tf)
        a = a.select(F.lit(tf).alias("timeframe"), "*").withColumn("change_pct", rnd("change_pct"))
        out = a if out is None else out.unionByName(a)
    return out


@query("asset_panel", "SRC-5 SRC-7", "SELECT date_trunc('hour', ts) AS ts, " + ", ".join(
    f"arg_max(CASE WHEN event_type = '{s}' THEN value END, CASE WHEN event_type = '{s}' THEN (ts, event_id) END) AS \"{s}\"" for s in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def asset_panel(spark, root):
    return B.panel(B.event_bars(spark, root), ["click", "error", "purchase", "signup", "view"], "close")


@query("drift_key_union", "JN-13 PF-17", f"""WITH {D.ALLOCATIONS_SQL}, am2 AS (SELECT o_custkey % 25 AS portfolio, 'a' || (l_suppkey % 12) AS asset, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT portfolio, asset, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY portfolio) AS DOUBLE) AS weight FROM am2)
SELECT coalesce(a.portfolio, b.portfolio) AS portfolio, round(max(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))), 6) AS drift
FROM al a FULL JOIN b ON a.portfolio = b.portfolio AND a.asset = b.asset GROUP BY 1""")
def drift_key_union(spark, root):
    from ..operators.portfolio import allocation_drift

    # assets by part now and by supplier before: a10 and a11 are only in the latter
    before = D.allocations(spark, root, F.concat(F.lit("a"), F.col("l_suppkey") % 12))
    return rounded(allocation_drift(D.allocations(spark, root), before), ["drift"])

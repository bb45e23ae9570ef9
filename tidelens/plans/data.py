"""Sources, sinks, filters, quality checks, rules, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import div, json_num, rnd, rounded
from ..operators import quality as Q
from ..operators import rules as U
from ..session import new_folder
from ..sources import bars as B
from ..sources import domain as D
from ..sources import logs, sinks
from ..sources.keyed import KeyedTable
from ..sources.tables import table
from .catalog import query
from .sqlkit import EVENT_BARS


@query("read_bars", "SRC-1 FLT-1 FLT-6 SRT-1", f"WITH {EVENT_BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def read_bars(spark, root):
    path = f"{new_folder(spark)}/bars.csv"
    Q.require_columns(B.event_bars(spark, root), ["symbol", "ts", "open", "high", "low", "close", "volume"]).write.option("header", True).csv(path)
    return B.read_bar_file(spark, path, "2024-01-05", "2024-01-20", 10)


@query("stored_prices", "SRC-3", f"WITH {EVENT_BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-25 18:00:00'")
def stored_prices(spark, root):
    folder = new_folder(spark)
    B.store_prices(B.event_bars(spark, root), folder, "1h")
    return B.read_prices(spark, folder, "click", "1h", "2024-01-03 06:00:00", "2024-01-25 18:00:00")


@query("normalise_candles", "SRC-4 FN-12", """SELECT event_type AS symbol, make_timestamp(CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) * 1000 ELSE (epoch_us(ts) // 1000000) * 1000000 END) AS ts,
 value AS open, value + 1 AS high, value - 1 AS low, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS close, CAST(event_id % 100 AS DOUBLE) AS volume FROM events""")
def normalise_candles(spark, root):
    e = table(spark, root, "events")
    t = F.when(F.col("event_id") % 2 == 0, F.unix_millis("ts")).otherwise(F.unix_seconds("ts"))
    raw = e.select(F.col("event_type").alias("symbol"), t.cast("string").alias("open_time"), F.col("value").cast("string").alias("open"), (F.col("value") + 1).cast("string").alias("high"),
                   (F.col("value") - 1).cast("string").alias("low"), F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("close"), (F.col("event_id") % 100).cast("string").alias("volume"))
    return B.normalise_candles(raw)


@query("order_book_depth", "SRC-6", """WITH b AS (SELECT l_orderkey, l_partkey AS market, l_discount < 0.05 AS bid, l_extendedprice / l_quantity AS price, l_quantity AS amount FROM lineitem)
SELECT market, CASE WHEN bid THEN 'bid' ELSE 'ask' END AS side, round(1e-9 + CASE WHEN bid THEN max(price) ELSE min(price) END, 4) AS best, sum(amount) AS depth, count(*) AS levels FROM b GROUP BY 1, bid""")
def order_book_depth(spark, root):
    li = table(spark, root, "lineitem")
    level = F.struct(div("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("amount"))
    bid = F.col("l_discount") < 0.05
    book = li.select(F.col("l_partkey").alias("market"), F.array_compact(F.array(F.when(bid, level))).alias("bids"), F.array_compact(F.array(F.when(~bid, level))).alias("asks"))
    sides = book.select("market", F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("rows")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("rows")))).alias("s"))
    lv = sides.select("market", F.col("s.side").alias("side"), F.inline("s.rows"))
    best = F.when(F.col("side") == "bid", F.max("price")).otherwise(F.min("price"))
    return lv.groupBy("market", "side").agg(rnd(best + 1e-9, 4).alias("best"), F.sum("amount").alias("depth"), F.count(F.lit(1)).alias("levels"))


_METRICS = ["active_addresses", "transaction_count", "fees", "hash_rate", "unknown"]


@query("on_chain_panel", "SRC-7", """WITH m AS (SELECT date_trunc('day', ts) AS ts, CASE event_type WHEN 'click' THEN 'active_addresses' WHEN 'view' THEN 'transaction_count' WHEN 'purchase' THEN 'fees' WHEN 'signup' THEN 'hash_rate' ELSE 'noise' END AS metric, CAST(value AS DECIMAL(18,2)) AS value FROM events)
SELECT ts, CAST(sum(value) FILTER (metric = 'active_addresses') AS DOUBLE) AS active_addresses, CAST(sum(value) FILTER (metric = 'transaction_count') AS DOUBLE) AS transaction_count, CAST(sum(value) FILTER (metric = 'fees') AS DOUBLE) AS fees FROM m WHERE metric IN ('active_addresses', 'transaction_count', 'fees') GROUP BY 1""")
def on_chain_panel(spark, root):
    names = {"click": "active_addresses", "view": "transaction_count", "purchase": "fees", "signup": "hash_rate"}
    m = table(spark, root, "events").select(F.date_trunc("day", "ts").alias("ts"), F.coalesce(U.lookup(names, F.col("event_type")), F.lit("noise")).alias("metric"), F.col("value").cast("decimal(18,2)").alias("value"))
    wanted = [n for n in ("active_addresses", "transaction_count", "fees", "made_up") if n in _METRICS]
    return m.filter(F.col("metric").isin(*wanted)).groupBy("ts").pivot("metric", wanted).agg(F.sum("value").cast("double"))


@query("sentiment_sources", "SRC-8", f"WITH {D.POSTS_SQL} SELECT platform, CAST(ts AS DATE) AS day, round(avg(sentiment), 6) + 0.0 AS sentiment, count(*) AS posts FROM posts WHERE platform IN ('src1', 'src2', 'src3') GROUP BY 1, 2")
def sentiment_sources(spark, root):
    p = D.posts(spark, root).filter(F.col("platform").isin("src1", "src2", "src3"))
    return p.groupBy("platform", F.to_date("ts").alias("day")).agg(rnd(F.avg("sentiment")).alias("sentiment"), F.count(F.lit(1)).alias("posts"))


@query("dataset_roundtrip", "SRC-9 SRC-10", f"WITH {EVENT_BARS} SELECT symbol, ts, close, volume FROM bars")
def dataset_roundtrip(spark, root):
    folder = new_folder(spark)
    b = B.event_bars(spark, root).select("symbol", "ts", "close", "volume")
    sinks.save_dataset(b, folder, "bars_csv", "csv", ["hourly"])
    return sinks.load_dataset(spark, folder, "bars_csv")


@query("processed_roundtrip", "SRC-11", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 BETWEEN 7 AND 8")
def processed_roundtrip(spark, root):
    path = f"{new_folder(spark)}/processed"
    part = F.when(F.col("o_orderkey") % 10 < 7, "train").when(F.col("o_orderkey") % 10 < 9, "val").otherwise("test")
    sinks.save_splits(table(spark, root, "orders").select("o_orderkey", "o_totalprice", part.alias("split")), path)
    return sinks.load_split(spark, path, "val").drop("split")


@query("agent_export", "SRC-12", """WITH p AS (SELECT o_custkey, count(*) AS positions, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
t AS (SELECT o_custkey, count(*) AS trades, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM orders GROUP BY 1)
SELECT f.format, c_custkey AS agent, c_name AS name, c_custkey % 20 AS vault, c_acctbal AS balance, coalesce(trades, 0) AS trades, coalesce(volume, 0) AS volume, coalesce(positions, 0) AS positions, coalesce(units, 0) AS units
FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey, (VALUES ('json'), ('csv')) f(format)""")
def agent_export(spark, root):
    """Every agent with its vault, trades and positions, exported as JSON and as CSV and read back."""
    orders = table(spark, root, "orders")
    t = orders.groupBy(F.col("o_custkey").alias("agent")).agg(F.count(F.lit(1)).alias("trades"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("volume"))
    li = table(spark, root, "lineitem").select("l_orderkey", "l_quantity")
    p = li.join(orders.select("o_orderkey", F.col("o_custkey").alias("agent")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("agent").agg(
        F.count(F.lit(1)).alias("positions"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("units"))
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_name").alias("name"), (F.col("c_custkey") % 20).alias("vault"), F.col("c_acctbal").alias("balance"))
    out = c.join(t, "agent", "left").join(p, "agent", "left").fillna(0, ["trades", "volume", "positions", "units"])
    folder, back = new_folder(spark), None
    for fmt in ("json", "csv"):
        writer = out.write.option("header", True) if fmt == "csv" else out.write
        writer.format(fmt).save(f"{folder}/agents.{fmt}")
        read = sinks.read_back(spark, f"{folder}/agents.{fmt}", fmt, out.schema).withColumn("format", F.lit(fmt))
        back = read if back is None else back.unionByName(read)
    return back


def chain_logs(spark, root):
    """Transactions whose logs hold one JSON event; some failed, some broken, some repeated."""
    e = table(spark, root, "events").withColumns({"m": F.col("user_id") % 20, "s": F.col("event_id") % 500})
    body = F.to_json(F.struct(F.col("m").alias("model_id"), F.col("s").alias("signal_id"), (F.col("user_id") % 7).alias("strategy_id"), F.col("user_id").alias("submitter"), F.unix_seconds("ts").alias("timestamp"), F.lit("momentum").alias("signal_type"),
                              (F.col("event_id") % 2 == 0).alias("verified"), F.col("user_id").alias("executor"), (F.col("value") - 40).alias("execution_result"), F.col("value").alias("price")))
    body = F.when(F.col("event_id") % 23 == 0, F.lit('{"model_id": broken')).otherwise(body)
    tag = F.when(F.col("event_type").isin("signup", "view"), "SignalSubmitted").when(F.col("event_type") == "purchase", "SignalExecuted").otherwise("Other")
    tx = e.select(F.concat(F.lit("sig"), "event_id").alias("signature"), F.when(F.col("event_id") % 17 == 0, "InstructionError").alias("err"),
                  F.array(F.lit("Program log: start"), F.concat(F.lit("Program log: "), tag, F.lit(" "), body)).alias("logs"), "event_id")
    return tx.drop("event_id").unionByName(tx.filter("event_id % 10 = 0").drop("event_id"))


@query("signal_log_index", "SRC-13 FN-9 SM-5 JN-8", """SELECT 'sig' || event_id AS signature, user_id % 20 AS model_id, event_id % 500 AS signal_id, user_id % 7 AS strategy_id, user_id AS submitter, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id % 2 = 0 AS verified
FROM events WHERE event_type IN ('signup', 'view') AND event_id % 17 <> 0 AND event_id % 23 <> 0""")
def signal_log_index(spark, root):
    return logs.once(logs.events(chain_logs(spark, root), "SignalSubmitted", logs.SIGNAL_SUBMITTED)).filter("signal_id IS NOT NULL").drop("position", "signal_type")


@query("unique_signals", "SRC-14 SET-3", """SELECT model_id, signal_id, min(timestamp) AS timestamp FROM (SELECT user_id % 20 AS model_id, event_id % 500 AS signal_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events WHERE event_type IN ('signup', 'view') AND event_id % 17 <> 0 AND event_id % 23 <> 0)
WHERE NOT model_id < 3 GROUP BY 1, 2""")
def unique_signals(spark, root):
    d = logs.events(chain_logs(spark, root), "SignalSubmitted", logs.SIGNAL_SUBMITTED).filter("signal_id IS NOT NULL").select("model_id", "signal_id", "timestamp", "signature")
    stored = d.filter("model_id < 3")
    return sinks.append_new(d, stored, ["model_id", "signal_id"], ["timestamp", "signature"]).drop("signature")


@query("signal_table", "SRC-14 SET-1", """SELECT model_id, signal_id, min(timestamp) AS timestamp FROM (SELECT user_id % 20 AS model_id, event_id % 500 AS signal_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events WHERE event_type IN ('signup', 'view') AND event_id % 17 <> 0 AND event_id % 23 <> 0) GROUP BY 1, 2""")
def signal_table(spark, root):
    """Three overlapping batches merged into a table on disk that holds each (model, signal) once."""
    d = logs.events(chain_logs(spark, root), "SignalSubmitted", logs.SIGNAL_SUBMITTED).filter("signal_id IS NOT NULL").select("model_id", "signal_id", "timestamp", "signature")
    t = KeyedTable(spark, f"{new_folder(spark)}/signals", ["model_id", "signal_id"], ["timestamp", "signature"])
    for k in range(3):
        t.upsert(d.filter(F.pmod("model_id", F.lit(3)) != k))
    return t.read().drop("signature")


@query("retention", "SRC-15 SM-9", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(spark, root):
    e = table(spark, root, "events").select("event_id", "ts")
    return sinks.keep_recent(e, "ts", 10, e.agg(F.max("ts")).scalar())


@query("flatten_report", "SRC-16 FN-11", """SELECT event_type AS symbol, count(*) AS summary_rows, round(avg(value), 6) AS summary_price_mean, max(value) AS summary_price_max FROM events GROUP BY 1""")
def flatten_report(spark, root):
    e = table(spark, root, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("a"), F.max("value").alias("b"))
    return sinks.flatten(e.select("symbol", F.struct(F.col("n").alias("rows"), F.struct(F.col("a").alias("mean"), F.col("b").alias("max")).alias("price")).alias("summary")))


# --- checks ---------------------------------------------------------------------

_HOLES = "hl AS (SELECT event_id, event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, user_id FROM events)"


def holes(spark, root):
    e = table(spark, root, "events")
    return e.select("event_id", "event_type", F.when(F.col("value") > 100, None).otherwise(F.col("value")).alias("value"),
                    F.when(F.col("event_id") % 3 == 0, None).otherwise(json_num("props", "$.k")).alias("k"), "user_id")


@query("null_share", "FLT-2 DP-1", f"WITH {_HOLES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) * 1.0 / count(*), 6) AS share, count(*) >= 100 AND count(*) FILTER ({c} IS NULL) * 1.0 / count(*) <= 0.1 AS ok FROM hl" for c in ("value", "k", "user_id")))
def null_share(spark, root):
    return rounded(Q.null_share(holes(spark, root), ["value", "k", "user_id"]), ["share"])


@query("outlier_share", "FLT-3", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers, round(avg(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END), 6) AS share,
 avg(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) > 0.01 AS report FROM (SELECT {c} AS v FROM lineitem), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in ("l_extendedprice", "l_quantity")))
def outlier_share(spark, root):
    return rounded(Q.outlier_share(table(spark, root, "lineitem"), ["l_extendedprice", "l_quantity"], 1.5), ["share"])


@query("time_gaps", "FLT-4", f"""WITH {EVENT_BARS}, s AS (SELECT symbol, ts, CAST(date_diff('second', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS BIGINT) AS step FROM bars), m AS (SELECT symbol, median(step) AS median_step FROM s GROUP BY 1)
SELECT symbol, ts, step, median_step FROM s JOIN m USING (symbol) WHERE step > 1.5 * median_step""")
def time_gaps(spark, root):
    return Q.gaps(B.numbered(B.event_bars(spark, root)), 1.5)


@query("duplicate_times", "FLT-5", "SELECT o_orderpriority AS symbol, count(*) AS rows, count(*) - count(DISTINCT o_orderdate) AS duplicates FROM orders GROUP BY 1")
def duplicate_times(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"))
    return Q.duplicate_times(o)


# --- filters, sorts, pages ------------------------------------------------------------


@query("search_text", "FLT-9 FN-1", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def search_text(spark, root):
    return table(spark, root, "part").filter(F.lower("p_name").contains("ring")).select("p_partkey", "p_name")


@query("vault_query", "FLT-10 FLT-7 FLT-8 SRT-2 SRT-3", """WITH m AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_size % 5 IN (1, 2, 3) AND p_retailprice BETWEEN 900 AND 1800)
SELECT *, 2 AS page, (SELECT count(*) FROM m) AS total, CAST(ceil((SELECT count(*) FROM m) / 20.0) AS BIGINT) AS pages FROM m ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20""")
def vault_query(spark, root):
    m = table(spark, root, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").filter(
        F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO") & (F.col("p_size") % 5).isin(1, 2, 3) & F.col("p_retailprice").between(900, 1800))
    return U.page(m, [F.col("p_retailprice").desc(), "p_partkey"], 2, 20)


@query("trade_query", "FLT-11", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_suppkey IN (3, 5, 8) AND l_returnflag = 'A' AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' ORDER BY l_shipdate DESC")
def trade_query(spark, root):
    li = table(spark, root, "lineitem").filter(F.col("l_suppkey").isin(3, 5, 8) & (F.col("l_returnflag") == "A") & F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1998-12-31").cast("timestamp")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").orderBy(F.col("l_shipdate").desc())


@query("audit_log_query", "FLT-12", "SELECT event_id, user_id, event_type AS action, ts FROM events WHERE event_type IN ('signup', 'error') AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def audit_log_query(spark, root):
    e = table(spark, root, "events").filter(F.col("event_type").isin("signup", "error") & F.col("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")))
    return e.select("event_id", "user_id", F.col("event_type").alias("action"), "ts")


@query("needed_columns", "FLT-14 FLT-15", f"WITH {_HOLES} SELECT event_id, value, k FROM hl WHERE value IS NOT NULL AND k IS NOT NULL")
def needed_columns(spark, root):
    return holes(spark, root).select("event_id", "value", "k").dropna()


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("columns_by_suffix", "FLT-16 SG-13", "WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events), w AS (SELECT date_trunc('hour', ts) AS ts, event_type AS asset, max(value) AS price, count(*) AS n FROM events GROUP BY 1, 2), "
       f"k AS (SELECT unnest({list(_KINDS)}) AS asset) SELECT h.ts, k.asset, price, CAST(coalesce(n, 0) AS DOUBLE) AS volume FROM h CROSS JOIN k LEFT JOIN w ON w.ts = h.ts AND w.asset = k.asset")
def columns_by_suffix(spark, root):
    from ..operators.signals import states_from_wide

    e = table(spark, root, "events")
    w = e.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(*[F.max(F.when(F.col("event_type") == a, F.col("value"))).alias(f"{a}_price") for a in _KINDS],
                                                               *[F.count_if(F.col("event_type") == a).cast("double").alias(f"{a}_volume") for a in _KINDS])
    return states_from_wide(w)


# --- business rules -----------------------------------------------------------------

_NAMES = ["uniswap", "aave", "compound", "curve", "yearn", "sushiswap"]
_AL = """al0 AS (SELECT o_custkey % 40 AS portfolio, CASE l_partkey % 6 WHEN 0 THEN 'uniswap' WHEN 1 THEN 'aave' WHEN 2 THEN 'compound' WHEN 3 THEN 'curve' WHEN 4 THEN 'yearn' ELSE 'sushiswap' END AS protocol, CAST(sum(l_quantity * (1 + (l_partkey % 6) * (o_custkey % 40 % 4) * 3)) AS BIGINT) AS amount
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), al AS (SELECT portfolio, protocol, round(100.0 * amount / sum(amount) OVER (PARTITION BY portfolio), 2) AS percentage, CASE portfolio % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'moderate' ELSE 'aggressive' END AS tolerance FROM al0)"""


def _percentages(spark, root):
    li, od = table(spark, root, "lineitem"), table(spark, root, "orders")
    i, p = F.col("l_partkey") % 6, F.col("o_custkey") % 40
    a = li.join(od, li.l_orderkey == od.o_orderkey).groupBy(p.alias("portfolio"), F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (i + 1).cast("int")).alias("protocol")).agg(
        F.sum(F.col("l_quantity") * (1 + i * (p % 4) * 3)).cast("long").alias("amount"))
    t = a.groupBy("portfolio").agg(F.sum("amount").alias("total"))
    tol = F.element_at(F.array(F.lit("conservative"), F.lit("moderate"), F.lit("aggressive")), (F.col("portfolio") % 3 + 1).cast("int"))
    return a.join(t, "portfolio").select("portfolio", "protocol", rnd(100.0 * F.col("amount") / F.col("total"), 2).alias("percentage"), tol.alias("tolerance"))


@query("allocation_sum_rule", "FLT-17", f"WITH {_AL} SELECT portfolio, round(sum(percentage), 4) AS total, abs(sum(percentage) - 100) <= 0.001 AS valid FROM al GROUP BY 1")
def allocation_sum_rule(spark, root):
    return rounded(U.allocation_sum(_percentages(spark, root)), ["total"], 4)


@query("allocation_limit_rule", "FLT-18", f"""WITH {_AL}, l AS (SELECT *, CASE tolerance WHEN 'conservative' THEN 30 WHEN 'moderate' THEN 50 ELSE 80 END AS cap, CASE tolerance WHEN 'conservative' THEN 20 WHEN 'moderate' THEN 40 ELSE 100 END AS vc FROM al),
g AS (SELECT portfolio, tolerance, coalesce(string_agg(DISTINCT protocol, ',' ORDER BY protocol) FILTER (percentage > cap), '') AS over_single, round(sum(percentage) FILTER (protocol IN ('curve', 'yearn')), 4) AS volatile_share, max(vc) AS vc FROM l GROUP BY 1, 2)
SELECT portfolio, tolerance, over_single, volatile_share, volatile_share > vc AS over_volatile, over_single = '' AND NOT volatile_share > vc AS valid FROM g""")
def allocation_limit_rule(spark, root):
    out = rounded(U.allocation_limits(_percentages(spark, root)), ["volatile_share"], 4)
    return out.withColumn("over_single", F.array_join("over_single", ","))


_STRATS = ["dca", "yield_farming", "liquidity_mining", "arbitrage", "market_neutral"]
_ST_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'dca' WHEN 1 THEN 'yield_farming' WHEN 2 THEN 'liquidity_mining' WHEN 3 THEN 'arbitrage' ELSE 'market_neutral' END"


def _strategy():
    return F.element_at(F.array(*[F.lit(s) for s in _STRATS]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("strategy")


@query("minimum_deposit_rule", "FLT-19", f"WITH d AS (SELECT o_orderkey, {_ST_SQL} AS strategy, o_totalprice / 50 AS amount FROM orders), m AS (SELECT *, CASE strategy WHEN 'dca' THEN 100 WHEN 'yield_farming' THEN 1000 WHEN 'liquidity_mining' THEN 1000 WHEN 'arbitrage' THEN 5000 ELSE 10000 END AS minimum FROM d) SELECT o_orderkey, strategy, minimum, amount >= minimum AS valid FROM m")
def minimum_deposit_rule(spark, root):
    d = table(spark, root, "orders").select("o_orderkey", _strategy(), (F.col("o_totalprice") / 50).alias("amount"))
    return U.minimum_deposit(d).drop("amount")


@query("compatibility_rule", "FLT-20 SET-2", f"""WITH d AS (SELECT o_orderkey, {_ST_SQL} AS strategy, CASE l_partkey % 6 WHEN 0 THEN 'uniswap' WHEN 1 THEN 'aave' WHEN 2 THEN 'compound' WHEN 3 THEN 'curve' WHEN 4 THEN 'yearn' ELSE 'sushiswap' END AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
ok AS (SELECT * FROM (VALUES ('yield_farming','aave'),('yield_farming','compound'),('yield_farming','yearn'),('liquidity_mining','uniswap'),('liquidity_mining','sushiswap'),('liquidity_mining','curve'),('market_neutral','uniswap'),('market_neutral','aave'),('market_neutral','compound')) t(s, p))
SELECT o_orderkey, strategy, coalesce(string_agg(DISTINCT d.p, ',' ORDER BY d.p) FILTER (strategy NOT IN ('dca', 'arbitrage') AND ok.p IS NULL), '') AS invalid, count(*) FILTER (strategy NOT IN ('dca', 'arbitrage') AND ok.p IS NULL) = 0 AS valid FROM d LEFT JOIN ok ON ok.s = d.strategy AND ok.p = d.p GROUP BY 1, 2""")
def compatibility_rule(spark, root):
    li, od = table(spark, root, "lineitem"), table(spark, root, "orders")
    p = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_partkey") % 6 + 1).cast("int"))
    d = li.join(od, li.l_orderkey == od.o_orderkey).groupBy("o_orderkey").agg(F.sort_array(F.collect_set(p)).alias("protocols"))
    out = U.protocol_compatibility(d.select("o_orderkey", _strategy(), "protocols"))
    return out.select("o_orderkey", "strategy", F.array_join("invalid", ",").alias("invalid"), "valid")


@query("rebalance_rule", "FLT-21", f"""WITH {_AL}, t AS (SELECT portfolio, protocol, 100.0 / 6 AS target FROM al), d AS (SELECT t.portfolio, abs(coalesce(percentage, 0) - target) / 100 AS drift FROM t LEFT JOIN al a ON a.portfolio = t.portfolio AND a.protocol = t.protocol)
SELECT portfolio, round(max(drift), 6) AS max_drift, count(*) FILTER (drift > 0.05) AS drifted, max(drift) > 0.05 AS rebalance FROM d GROUP BY 1""")
def rebalance_rule(spark, root):
    a = _percentages(spark, root)
    return rounded(U.rebalance_drift(a, a.withColumn("percentage", F.lit(100.0 / 6))), ["max_drift"])


# --- sets, scalar functions ---------------------------------------------------------


@query("append_batches", "SET-1", "SELECT event_id, value FROM events UNION ALL SELECT -event_id - 1, value * 2 FROM events WHERE event_type = 'click'")
def append_batches(spark, root):
    e = table(spark, root, "events")
    return e.select("event_id", "value").unionByName(e.filter("event_type = 'click'").select((-F.col("event_id") - 1).alias("event_id"), (F.col("value") * 2).alias("value")))


@query("key_sets", "SET-2", "SELECT 'only_left' AS side, k FROM (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) UNION ALL SELECT 'both', k FROM (SELECT user_id AS k FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def key_sets(spark, root):
    e = table(spark, root, "events")
    a = e.filter("event_type = 'click'").select(F.col("user_id").alias("k"))
    b = e.filter("event_type = 'error' AND value > 60").select(F.col("user_id").alias("k"))
    return a.subtract(b).select(F.lit("only_left").alias("side"), "k").unionByName(a.intersect(b).select(F.lit("both").alias("side"), "k"))


@query("string_functions", "FN-1 FN-2", r"""SELECT c_custkey, lower(replace(c_name, '#', '-')) AS slug, split_part(c_name, '#', 2) AS tail, contains(c_name, '99') AS has_99, starts_with(c_mktsegment, 'B') AS b_segment, regexp_matches(md5(c_name), '^[1-9a-f]{32}$') AS key_like, trim('  ' || c_mktsegment || ' ') AS segment FROM customer""")
def string_functions(spark, root):
    return table(spark, root, "customer").select(
        "c_custkey", F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.col("c_name").contains("99").alias("has_99"),
        F.col("c_mktsegment").startswith("B").alias("b_segment"), F.md5("c_name").rlike("^[1-9a-f]{32}$").alias("key_like"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("segment"))


@query("json_functions", "FN-8 FN-12", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), 0) AS missing FROM events""")
def json_functions(spark, root):
    return table(spark, root, "events").select("event_id", F.coalesce(json_num("props", "$.k"), F.lit(0.0)).alias("k"), F.coalesce(json_num("props", "$.missing"), F.lit(0.0)).alias("missing"))


@query("array_functions", "FN-6", "SELECT user_id, list_max(l) AS top, l[1] AS lowest, len(l) AS n, round(list_avg(l[1:3]), 6) AS first_three FROM (SELECT user_id, list(DISTINCT event_id % 50 ORDER BY event_id % 50) AS l FROM events GROUP BY 1)")
def array_functions(spark, root):
    a = table(spark, root, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 50)).alias("l"))  # at most 50 values
    three = F.slice("l", 1, 3)
    return a.select("user_id", F.array_max("l").alias("top"), F.element_at("l", 1).alias("lowest"), F.size("l").cast("long").alias("n"),
                    rnd(F.aggregate(three, F.lit(0.0), lambda s, x: s + x) / F.size(three)).alias("first_three"))


@query("variant_assignment", "FN-10 SG-14", """SELECT event_id, CAST((('0x' || substr(md5(CAST(event_id AS VARCHAR)), 17, 16))::UBIGINT % 3 + (('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 16))::UBIGINT % 3) * (18446744073709551615::UBIGINT % 3 + 1)) % 3 AS BIGINT) AS variant FROM events""")
def variant_assignment(spark, root):
    return table(spark, root, "events").select("event_id", U.variant(F.col("event_id"), 3).alias("variant"))


_AB = "ab AS (SELECT event_type AS variant, value AS x FROM events)"


@query("ab_summary", "AG-34", f"WITH {_AB} SELECT variant, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.025), 6) AS lower, round(quantile_cont(x, 0.975), 6) AS upper FROM ab GROUP BY 1")
def ab_summary(spark, root):
    from ..operators.quantile import exact_quantiles

    e = table(spark, root, "events").select(F.col("event_type").alias("variant"), F.col("value").alias("x"))
    q = exact_quantiles(e, ["variant"], "x", [0.025, 0.975], ["lower", "upper"])
    g = e.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return rounded(g.join(q, "variant"), ["mean", "std", "lower", "upper"])


@query("latency_trend", "AG-35", """WITH r AS (SELECT event_type AS model, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT model, round(avg(value) FILTER (rn <= 100), 6) AS recent, round(avg(value) FILTER (rn BETWEEN 101 AND 200), 6) AS earlier,
 round((avg(value) FILTER (rn <= 100) - avg(value) FILTER (rn BETWEEN 101 AND 200)) / avg(value) FILTER (rn BETWEEN 101 AND 200), 6) AS trend FROM r WHERE rn <= 200 GROUP BY 1""")
def latency_trend(spark, root):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    r = table(spark, root, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 200")
    new, old = F.avg(F.when(F.col("rn") <= 100, F.col("value"))), F.avg(F.when(F.col("rn") > 100, F.col("value")))
    return r.groupBy(F.col("event_type").alias("model")).agg(rnd(new).alias("recent"), rnd(old).alias("earlier"), rnd(div(new - old, old)).alias("trend"))

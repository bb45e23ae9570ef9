"""The domain inputs, derived from the given tables.

Derivations are plain integer arithmetic on the keys so that the DuckDB side of a check
can spell them the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import json_num
from .tables import table

# Event kinds of the ledger (fixed values) for the event types of the given table.
EVENT_KINDS = {"purchase": "swap", "click": "add_liquidity", "view": "remove_liquidity", "signup": "fee_collection",
               "error": "other"}
VOLUME_KINDS = ["swap", "add_liquidity", "remove_liquidity"]


def protocol_events(spark: SparkSession, root: str) -> DataFrame:
    ev = table(spark, root, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv]), F.col("event_type"))
    return ev.select(
        "event_id", "ts", F.concat(F.lit("p"), F.col("user_id") % 10).alias("protocol"), F.col("user_id").alias("user"),
        kind.alias("kind"), "value", F.col("props").alias("metadata"),
    )


def protocol_history(spark: SparkSession, root: str) -> DataFrame:
    """One metrics row per protocol and day."""
    ev = protocol_events(spark, root)
    return ev.groupBy("protocol", F.date_trunc("day", "ts").alias("ts")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("tvl"),
        F.sum(json_num("metadata", "$.k")).alias("volume"),
        F.count_distinct("user").alias("users"),
        F.count(F.lit(1)).alias("transactions"),
    )


def positions(spark: SparkSession, root: str) -> DataFrame:
    li = table(spark, root, "lineitem")
    od = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    su = table(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey).join(su, li.l_suppkey == su.s_suppkey)
        .select(
            F.col("o_custkey").alias("portfolio"), F.col("o_custkey").alias("user"),
            F.concat(F.lit("n"), F.col("s_nationkey")).alias("protocol"), F.col("l_partkey").alias("pool"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), (F.col("l_linestatus") == "O").alias("active"),
            F.col("l_shipdate").alias("ts"), F.col("l_discount").alias("apy"), F.col("l_tax").alias("farming"),
            F.col("l_quantity").alias("quantity"),
        )
    )


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Vault transactions from orders; status F deposits, O withdraws, P pays fees."""
    od = table(spark, root, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "deposit").when(F.col("o_orderstatus") == "O", "withdrawal").otherwise("fee")
    return od.select(
        F.col("o_orderkey").alias("tx"), (F.col("o_custkey") % 20).alias("vault"), F.col("o_custkey").alias("user"),
        kind.alias("kind"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("priority"),
    )


def portfolio_values(spark: SparkSession, root: str) -> DataFrame:
    """Value of 25 portfolios per order date."""
    od = table(spark, root, "orders")
    return od.groupBy((F.col("o_custkey") % 25).alias("portfolio"), F.col("o_orderdate").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def market_values(spark: SparkSession, root: str) -> DataFrame:
    od = table(spark, root, "orders")
    return od.groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("market"))


def allocations(spark: SparkSession, root: str, asset=None) -> DataFrame:
    """Weights of the assets (ten, if not given) in each of 25 portfolios, by supplied value."""
    asset = F.concat(F.lit("a"), F.col("l_partkey") % 10) if asset is None else asset
    li = table(spark, root, "lineitem")
    od = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    amounts = (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .groupBy((F.col("o_custkey") % 25).alias("portfolio"), asset.alias("asset"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    )
    total = amounts.groupBy("portfolio").agg(F.sum("amount").alias("total"))
    return amounts.join(total, "portfolio").select(
        "portfolio", "asset", (F.col("amount").cast("double") / F.col("total").cast("double")).alias("weight"))


PROTOCOLS = [f"p{i}" for i in range(10)]


def posts(spark: SparkSession, root: str) -> DataFrame:
    """Scored posts from documents; scores, authors and tags follow from the id."""
    d = table(spark, root, "documents")
    i = F.col("doc_id")
    tags = F.when(i % 7 == 0, F.array(F.concat(F.lit("p"), i % 10), F.concat(F.lit("p"), (i + 3) % 10))).otherwise(
        F.array(F.concat(F.lit("p"), i % 10)))
    return d.select(
        i.alias("post_id"), F.col("source").alias("platform"), F.col("text").alias("content"), "lang",
        F.concat(F.lit("u"), i % 97).alias("author"), ((i * 37) % 200 * 100).alias("followers"),
        F.timestamp_seconds(F.lit(1704067200) + (i * 7919) % 172800).alias("ts"),
        (((i * 31) % 201 - 100) / 100.0).alias("sentiment"), (0.5 + (i % 50) / 100.0).alias("confidence"),
        F.create_map(F.lit("likes"), F.col("n_chars") % 100, F.lit("shares"), i % 13).alias("engagement"),
        tags.alias("protocols"),
    )


POSTS_SQL = """posts AS (
  SELECT doc_id AS post_id, source AS platform, text AS content, lang, 'u' || (doc_id % 97) AS author,
         (doc_id * 37) % 200 * 100 AS followers, make_timestamp(1704067200000000 + ((doc_id * 7919) % 172800) * 1000000) AS ts,
         ((doc_id * 31) % 201 - 100) / 100.0 AS sentiment, 0.5 + (doc_id % 50) / 100.0 AS confidence,
         n_chars % 100 + doc_id % 13 AS engagement,
         CASE WHEN doc_id % 7 = 0 THEN ['p' || (doc_id % 10), 'p' || ((doc_id + 3) % 10)] ELSE ['p' || (doc_id % 10)] END AS protocols
  FROM documents),
pp AS (SELECT unnest(protocols) AS protocol, * EXCLUDE (protocols) FROM posts)"""

PROTOCOL_EVENTS_SQL = """pe AS (
  SELECT event_id, ts, 'p' || (user_id % 10) AS protocol, user_id AS "user", value, props AS metadata,
         CASE event_type WHEN 'purchase' THEN 'swap' WHEN 'click' THEN 'add_liquidity' WHEN 'view' THEN 'remove_liquidity'
              WHEN 'signup' THEN 'fee_collection' ELSE 'other' END AS kind,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""

HISTORY_SQL = PROTOCOL_EVENTS_SQL + """,
ph AS (SELECT protocol, date_trunc('day', ts) AS ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS tvl, sum(k) AS volume,
              count(DISTINCT "user") AS users, count(*) AS transactions FROM pe GROUP BY 1, 2)"""

POSITIONS_SQL = """pos AS (
  SELECT o_custkey AS portfolio, o_custkey AS "user", 'n' || s_nationkey AS protocol, l_partkey AS pool,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS value, l_linestatus = 'O' AS active, l_shipdate AS ts,
         l_discount AS apy, l_tax AS farming, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""

LEDGER_SQL = """led AS (
  SELECT o_orderkey AS tx, o_custkey % 20 AS vault, o_custkey AS "user",
         CASE o_orderstatus WHEN 'F' THEN 'deposit' WHEN 'O' THEN 'withdrawal' ELSE 'fee' END AS kind,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS ts, o_orderpriority AS priority FROM orders)"""

VALUES_SQL = """pv AS (
  SELECT o_custkey % 25 AS portfolio, o_orderdate AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2),
mv AS (SELECT o_orderdate AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS market FROM orders GROUP BY 1)"""

ALLOCATIONS_SQL = """am AS (
  SELECT o_custkey % 25 AS portfolio, 'a' || (l_partkey % 10) AS asset, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
al AS (SELECT portfolio, asset, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY portfolio) AS DOUBLE) AS weight FROM am)"""

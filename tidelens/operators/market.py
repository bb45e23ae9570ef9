"""Protocol, token and market roll-ups.

Every roll-up is one grouped aggregate over all protocols with conditional sums, where
a per-protocol loop of single-measure queries would scan the facts many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import div, json_num
from ..sources.domain import VOLUME_KINDS
from .joins import latest


def newest(df: DataFrame, time: str = "ts") -> Column:
    """The newest event time as a scalar: 'now' for a stored log."""
    return df.agg(F.max(time)).scalar()


def tvl(positions: DataFrame) -> DataFrame:
    return positions.groupBy("protocol").agg(F.sum(F.when(F.col("active"), F.col("value"))).cast("double").alias("tvl"))


def day_activity(events: DataFrame, now: Column) -> DataFrame:
    """Volume, fees, transactions and users of the last 24 hours per protocol."""
    amount = json_num("metadata", "$.k").cast("decimal(38,8)")
    return (
        events.filter(F.col("ts") >= now - F.expr("INTERVAL 24 HOURS"))
        .groupBy("protocol").agg(
            F.coalesce(F.sum(F.when(F.col("kind").isin(VOLUME_KINDS), amount)).cast("double"), F.lit(0.0)).alias("volume_24h"),
            F.coalesce(F.sum(F.when(F.col("kind") == "fee_collection", amount)).cast("double"), F.lit(0.0)).alias("fees_24h"),
            F.count(F.lit(1)).alias("transactions_24h"),
            F.count_distinct("user").alias("users_24h"),
        )
    )


def recent(history: DataFrame, key: str, n: int, time: str = "ts") -> DataFrame:
    """Last ``n`` rows per key; Spark keeps only n rows per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def simple_returns(df: DataFrame, key: str, value: str) -> DataFrame:
    """Returns over a bounded recent window (after ``recent``); a zero base gives 0."""
    w = Window.partitionBy(key).orderBy(F.col("rank").desc())
    prev = F.lag(value).over(w)
    return df.withColumn("ret", F.when(prev.isNotNull(), F.coalesce(div(F.col(value) - prev, prev), F.lit(0.0))))


def series_volatility(history: DataFrame, key: str, value: str, n: int = 30) -> DataFrame:
    r = simple_returns(recent(history, key, n), key, value)
    return r.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.stddev_samp("ret").alias("volatility"))


def volatility_index(history: DataFrame, key: str, value: str, n: int = 30, least: int = 10) -> DataFrame:
    v = series_volatility(history, key, value, n).filter(F.col("points") >= least)
    return v.agg(F.avg("volatility").alias("volatility_index"), F.count(F.lit(1)).alias("series"))


def growth(history: DataFrame, key: str, value: str, now: Column, back: str) -> DataFrame:
    """Percent change against the last row at or before ``now - back``; 0 without a base."""
    cur = latest(history.select(key, "ts", value), [key], ["ts"]).select(key, F.col(value).alias("_now"))
    old = latest(history.select(key, "ts", value), [key], ["ts"], now - F.expr(f"INTERVAL {back}")).select(
        key, F.col(value).alias("_old"))
    g = 100.0 * div(F.col("_now") - F.col("_old"), "_old")
    return cur.join(old, key, "left").select(key, F.coalesce(g, F.lit(0.0)).alias("growth"))


def risk_score(history: DataFrame, events: DataFrame) -> DataFrame:
    """min(10*volatility, 30), +20 under 100 users, +10, capped at 100."""
    vol = series_volatility(history, "protocol", "tvl")
    users = events.groupBy("protocol").agg(F.count_distinct("user").alias("users"))
    part = F.when(F.col("points") >= 10, F.least(F.col("volatility") * 10.0, F.lit(30.0))).otherwise(0.0)
    few = F.when(F.col("users") < 100, 20.0).otherwise(0.0)
    return users.join(vol, "protocol", "left").select(
        "protocol", F.least(F.coalesce(part, F.lit(0.0)) + few + 10.0, F.lit(100.0)).alias("risk_score"))


def protocol_metrics(events: DataFrame, history: DataFrame) -> DataFrame:
    """The full metrics row of every protocol."""
    now = newest(events)
    value = events.groupBy("protocol").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("tvl"))
    out = value.join(day_activity(events, now), "protocol", "left")
    out = out.join(growth(history, "protocol", "tvl", now, "7 DAYS"), "protocol", "left")
    return out.join(risk_score(history, events), "protocol", "left").fillna(
        0, ["volume_24h", "fees_24h", "transactions_24h", "users_24h"])


def market_totals(history: DataFrame) -> DataFrame:
    """Sums over the newest row of every protocol, with dominance and liquidity index."""
    last = latest(history, ["protocol"], ["ts"])
    return last.agg(
        F.sum("tvl").alias("total_tvl"), F.sum("volume").alias("total_volume"),
        (100.0 * div(F.max("tvl"), F.sum("tvl"))).alias("dominance_index"),
        F.coalesce(F.least(100.0 * div(F.sum("volume"), F.sum("tvl")), F.lit(100.0)), F.lit(0.0)).alias("liquidity_index"),
        F.count(F.lit(1)).alias("protocols"),
    )


def token_metrics(ticks: DataFrame, now: Column) -> DataFrame:
    """Price, change against 24 hours ago, quote volume of 24 hours, volatility of 7 days."""
    order = F.struct("ts", "tie")
    day, week = now - F.expr("INTERVAL 24 HOURS"), now - F.expr("INTERVAL 7 DAYS")
    old = F.max_by("price", F.when(F.col("ts") <= day, order))
    base = ticks.groupBy("symbol").agg(
        F.max_by("price", order).alias("price"), old.alias("price_24h_ago"),
        F.sum(F.when(F.col("ts") >= day, F.col("volume") * F.col("price"))).alias("volume_24h"),
    )
    hourly = ticks.filter(F.col("ts") >= week).groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(
        F.max_by("price", order).alias("p"))
    w = Window.partitionBy("symbol").orderBy("h")  # at most 169 hours per symbol
    prev = F.lag("p").over(w)
    ret = hourly.withColumn("ret", F.when(prev.isNotNull(), F.coalesce(div(F.col("p") - prev, prev), F.lit(0.0))))
    vol = ret.groupBy("symbol").agg(F.stddev_samp("ret").alias("volatility_7d"))
    return base.join(vol, "symbol", "left").withColumn(
        "change_24h", 100.0 * div(F.col("price") - F.col("price_24h_ago"), "price_24h_ago"))


TILE = 64  # series of a block, about
CHUNK = 512  # points in time of a block, about


def correlation_pairs(rows: DataFrame, series: str, time: str, value: str, least: int = 10) -> DataFrame:
    """left, right, points and Pearson correlation of every pair of series over their common times; a pair needs ``least`` of them, an
    undefined correlation is 0.

    Series are dealt into groups and times into chunks; a block holds the values of one group in one chunk. Blocks of a chunk meet in
    pairs, and a tile of two blocks gives the sums of all its pairs by products of matrices, so a value is sent to as many tiles as there
    are groups, not to every other series, and the plan is the same for any number of series. Values are taken less the least of their
    series, which keeps the sums small.
    """
    low = rows.groupBy(series).agg(F.min(value).alias("_low"))
    x = rows.filter(F.col(value).isNotNull()).join(low, series).select(F.col(series).alias("s"), F.col(time).alias("t"), (F.col(value) - F.col("_low")).alias("v"))
    size = x.agg(F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("t").alias("t")).first()
    groups, chunks = (max(1, -(-size[c] // n)) for c, n in (("s", TILE), ("t", CHUNK)))
    block = x.groupBy(F.pmod(F.xxhash64("t"), F.lit(chunks)).alias("chunk"), F.pmod(F.xxhash64("s"), F.lit(groups)).alias("g")).agg(
        F.collect_list("s").alias("s"), F.collect_list(F.xxhash64("t")).alias("t"), F.collect_list("v").alias("v"))  # one tile's side
    a, b = (block.select("chunk", *[F.col(c).alias(f"{c}{i}") for c in "gstv"]) for i in "ab")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = a.join(b, "chunk").filter("ga <= gb").repartition(n, "ga", "gb")
    kind = dict(x.dtypes)["s"]
    sums = tiles.mapInPandas(_tile_sums, f"left {kind}, right {kind}, " + ", ".join(f"{c} double" for c in _SUMS))
    t = sums.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in _SUMS])
    xx, yy = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    flat = (xx <= 1e-12 * F.col("n") * F.col("xx")) | (yy <= 1e-12 * F.col("n") * F.col("yy"))
    r = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(xx * yy)
    return t.filter(F.col("n") >= least).select("left", "right", F.col("n").cast("long").alias("points"), F.when(flat, 0.0).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("correlation"))


_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _tile_sums(frames):
    import numpy as np
    import pandas as pd

    def matrix(names, times, values, index):
        who, at = np.unique(np.asarray(names, dtype=object), return_inverse=True)
        m = np.full((len(index), len(who)), np.nan)
        m[[index[t] for t in times], at] = values
        has = ~np.isnan(m)
        return who, np.where(has, m, 0.0), has.astype(float)

    for pdf in frames:
        for r in pdf.itertuples(index=False):
            index = {t: i for i, t in enumerate(np.union1d(r.ta, r.tb).tolist())}
            (wa, a, ha), (wb, b, hb) = matrix(r.sa, r.ta, r.va, index), matrix(r.sb, r.tb, r.vb, index)
            sums = [ha.T @ hb, a.T @ hb, ha.T @ b, (a * a).T @ hb, ha.T @ (b * b), a.T @ b]
            i, j = np.nonzero((wa[:, None] < wb[None, :]) if r.ga == r.gb else np.ones((len(wa), len(wb)), bool))
            left, right, (n, x, y, xx, yy, xy) = wa[i], wb[j], (s[i, j] for s in sums)
            turn = left > right  # the smaller name stands left
            yield pd.DataFrame({"left": np.where(turn, right, left), "right": np.where(turn, left, right), "n": n, "x": np.where(turn, y, x), "y": np.where(turn, x, y),
                                "xx": np.where(turn, yy, xx), "yy": np.where(turn, xx, yy), "xy": xy})[n > 0]


def market_share(protocol_tvl: DataFrame) -> DataFrame:
    total = protocol_tvl.agg(F.sum("tvl")).scalar()
    return protocol_tvl.select("protocol", "tvl", (100.0 * div("tvl", total)).alias("share"))


def pool_liquidity(positions: DataFrame) -> DataFrame:
    pools = positions.filter("active").groupBy("protocol", "pool").agg(F.sum("value").alias("v"))
    return pools.groupBy("protocol").agg(
        F.sum("v").cast("double").alias("total_liquidity"), F.count(F.lit(1)).alias("pools"),
        div(F.sum("v"), F.count(F.lit(1))).alias("average_depth"))


def yield_rollup(positions: DataFrame) -> DataFrame:
    """From nested JSON: yield amount, apy weighted by value, farming and staking rewards."""
    data = F.to_json(F.struct(
        F.struct((F.col("quantity") * F.col("apy")).alias("amount")).alias("yield"), "apy",
        F.struct("farming", F.col("quantity").alias("staking")).alias("rewards")))
    p = positions.filter("active").withColumn("position_data", data)
    num = lambda path: F.coalesce(json_num("position_data", path), F.lit(0.0))
    return p.groupBy("portfolio").agg(
        F.sum(num("$.yield.amount")).alias("total_yield"),
        F.sum(num("$.apy") * F.col("value").cast("double") / 100.0).alias("weighted_apy"),
        F.sum(num("$.rewards.farming")).alias("farming_rewards"),
        F.sum(num("$.rewards.staking")).alias("staking_rewards"))


def whale_transfers(transfers: DataFrame, amount: str, floor: float, k: int) -> DataFrame:
    return transfers.filter(F.col(amount) >= floor).orderBy(F.col(amount).desc(), "tx").limit(k)


def trend_frame(history: DataFrame, key: str, value: str, timeframe: str) -> DataFrame:
    """Rows of the last hour, day, week or month with the change since the frame's start."""
    span = {"1h": "1 HOUR", "1d": "1 DAY", "7d": "7 DAYS", "30d": "30 DAYS"}[timeframe]
    part = history.filter(F.col("ts") >= newest(history) - F.expr(f"INTERVAL {span}"))
    return part.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.min_by(value, "ts").alias("first"), F.max_by(value, "ts").alias("last"),
        (100.0 * div(F.max_by(value, "ts") - F.min_by(value, "ts"), F.min_by(value, "ts"))).alias("change_pct"))

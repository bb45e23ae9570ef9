"""Business rules over long allocation rows and deposits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Caps in percent by risk tolerance, volatile protocols, minimum deposits, allowed protocols.
RISK_LIMITS = {"conservative": (30, 20), "moderate": (50, 40), "aggressive": (80, 100)}
VOLATILE = ("curve", "yearn")
MIN_DEPOSIT = {"dca": 100, "yield_farming": 1000, "liquidity_mining": 1000, "arbitrage": 5000, "market_neutral": 10000}
PROTOCOLS = ("uniswap", "aave", "compound", "curve", "yearn", "sushiswap")
ALLOWED = {
    "dca": PROTOCOLS,
    "yield_farming": ("aave", "compound", "yearn"),
    "liquidity_mining": ("uniswap", "sushiswap", "curve"),
    "arbitrage": PROTOCOLS,
    "market_neutral": ("uniswap", "aave", "compound"),
}


def lookup(table: dict, key: Column) -> Column:
    """A small fixed table as a map literal: no join at all."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]), key)


def allocation_sum(rows: DataFrame) -> DataFrame:
    """Percentages must add up to 100 within 0.001."""
    return rows.groupBy("portfolio").agg(F.sum("percentage").alias("total"), (F.abs(F.sum("percentage") - 100.0) <= 0.001).alias("valid"))


def allocation_limits(rows: DataFrame) -> DataFrame:
    """Single cap and volatile cap of the portfolio's risk tolerance, with the offending protocols."""
    single = lookup({k: v[0] for k, v in RISK_LIMITS.items()}, F.col("tolerance"))
    volatile = lookup({k: v[1] for k, v in RISK_LIMITS.items()}, F.col("tolerance"))
    over = F.when(F.col("percentage") > single, F.col("protocol"))
    share = F.sum(F.when(F.col("protocol").isin(*VOLATILE), F.col("percentage")).otherwise(0.0))
    g = rows.groupBy("portfolio", "tolerance").agg(F.sort_array(F.collect_set(over)).alias("over_single"), share.alias("volatile_share"))
    broken = F.col("volatile_share") > volatile
    return g.withColumns({"over_volatile": broken, "valid": (F.size("over_single") == 0) & ~broken})


def minimum_deposit(rows: DataFrame) -> DataFrame:
    least = lookup(MIN_DEPOSIT, F.col("strategy"))
    return rows.withColumns({"minimum": least, "valid": F.col("amount") >= least})


def protocol_compatibility(rows: DataFrame) -> DataFrame:
    """Needs strategy and ``protocols`` (array): the ones outside the strategy's allowed set."""
    allowed = lookup({k: F.array(*[F.lit(p) for p in v]) for k, v in ALLOWED.items()}, F.col("strategy"))
    bad = F.array_except("protocols", allowed)
    return rows.withColumns({"invalid": bad, "valid": F.size(bad) == 0})


def rebalance_drift(current: DataFrame, target: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Largest |current - target|/100 over the target's protocols; a missing holding is 0."""
    j = target.select("portfolio", "protocol", F.col("percentage").alias("_t")).join(
        current.select("portfolio", "protocol", F.col("percentage").alias("_c")), ["portfolio", "protocol"], "left")
    drift = F.abs(F.coalesce("_c", F.lit(0.0)) - F.col("_t")) / 100.0
    g = j.groupBy("portfolio").agg(F.max(drift).alias("max_drift"), F.count_if(drift > threshold).alias("drifted"))
    return g.withColumn("rebalance", F.col("max_drift") > threshold)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page with the totals beside it; only the rows up to the page are kept by the sort."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"page": F.lit(number), "total": total, "pages": F.ceil(total / size)})


def variant(key: Column, variants: int) -> Column:
    """md5(key) modulo ``variants``, folded over the 128-bit digest 32 bits at a time."""
    digest = F.md5(key.cast("string"))
    shift = 2**32 % variants
    out = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        out = (out * shift + part) % variants
    return out

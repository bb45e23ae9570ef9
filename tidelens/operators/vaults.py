"""Vault ledgers, NAV returns, fees, participants and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import div
from ..functions.rolling import lag
from .joins import latest
from .ordered import floored_sum
from .series import blocks, number_rows, prefix, unblock


def flow_totals(ledger: DataFrame, key: str) -> DataFrame:
    """Deposits, withdrawals and fees per key in one pass."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).cast("double")
    return ledger.groupBy(key).agg(part("deposit").alias("deposits"), part("withdrawal").alias("withdrawals"), part("fee").alias("fees"))


def running_balance(ledger: DataFrame, key: str = "vault") -> DataFrame:
    """Balance after each transaction, floored at 0 at every step.

    Vaults are laid out in ranges of rows, and a range hands on its sum and its least sum."""
    signed = F.when(F.col("kind") == "deposit", F.col("amount")).when(F.col("kind") == "withdrawal", -F.col("amount")).otherwise(0)
    x = floored_sum(ledger.withColumn("_d", signed.cast("decimal(28,2)")), [key], ["ts", "tx"], "_d", "balance")
    return x.withColumn("balance", F.col("balance").cast("double")).drop("_d")


def participant_stats(flows: DataFrame, now) -> DataFrame:
    """flows: (vault, user, amount, joined, exited). Totals, active, retention, holding days."""
    held = F.datediff(F.coalesce("exited", now), F.col("joined"))
    return flows.groupBy("vault").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("exited").isNull()).alias("active"),
        F.sum("amount").alias("deposits"), F.avg("amount").alias("mean_size"),
        div(F.count_if(F.col("exited").isNull()), F.count(F.lit(1))).alias("retention_rate"),
        F.avg(held).alias("mean_holding_days"))


def activity_stats(ledger: DataFrame) -> DataFrame:
    order = F.struct("ts", "tx")
    dep, wd = F.col("kind") == "deposit", F.col("kind") == "withdrawal"
    amount = F.col("amount").cast("double")
    return ledger.groupBy("vault").agg(
        F.count_if(dep).alias("deposit_count"), F.avg(F.when(dep, amount)).alias("deposit_mean"),
        F.count_if(wd).alias("withdrawal_count"), F.avg(F.when(wd, amount)).alias("withdrawal_mean"),
        F.max_by("tx", F.when(dep, order)).alias("last_deposit"), F.max_by("tx", F.when(wd, order)).alias("last_withdrawal"))


# Return periods (fixed values).
NAV_PERIODS = {"daily": "1 DAY", "weekly": "7 DAYS", "monthly": "30 DAYS", "quarterly": "90 DAYS", "yearly": "365 DAYS"}


def nav_returns(nav: DataFrame, now) -> DataFrame:
    """Return in basis points against the last NAV at or before each period's start.

    All cutoffs are read in one grouped aggregate.
    """
    aggs = [F.max_by("nav", "ts").alias("nav"), F.min_by("nav", "ts").alias("_inception")]
    for name, span in NAV_PERIODS.items():
        aggs.append(F.max_by("nav", F.when(F.col("ts") <= now - F.expr(f"INTERVAL {span}"), F.col("ts"))).alias(f"_{name}"))
    out = nav.groupBy("vault").agg(*aggs)
    bps = [F.floor(10000.0 * div(F.col("nav") - F.col(f"_{n}"), f"_{n}")).alias(f"{n}_bps") for n in [*NAV_PERIODS, "inception"]]
    return out.select("vault", "nav", *bps)


def fees(nav: DataFrame, performance_bps: int = 2000, entry_bps: int = 50, exit_bps: int = 100) -> DataFrame:
    """High-water mark before each row and the performance fee above it, entry and exit fees of the amount.

    ``nav`` has (vault, ts, nav, amount).
    """
    x = number_rows(nav.withColumnRenamed("vault", "symbol"))
    x = prefix(x, {"high_water_mark": ("max", F.col("nav"))})
    y = unblock(blocks(x, 1).withColumn("mark_before", lag("high_water_mark"))).withColumnRenamed("symbol", "vault")
    gain = F.greatest(F.col("nav") - F.coalesce("mark_before", F.col("nav")), F.lit(0.0))
    return y.select("vault", "ts", "nav", "high_water_mark", (gain * performance_bps / 10000.0).alias("performance_fee"),
                    (F.col("amount") * entry_bps / 10000.0).alias("entry_fee"), (F.col("amount") * exit_bps / 10000.0).alias("exit_fee"))


def user_positions(shares: DataFrame, nav: DataFrame) -> DataFrame:
    """shares (vault, user, shares) times the newest NAV."""
    last = latest(nav.select("vault", "ts", "nav"), ["vault"], ["ts"])
    return shares.join(last, "vault").select("vault", "user", "shares", (F.col("shares") * F.col("nav")).alias("value"))


def simple_apy(values: DataFrame) -> DataFrame:
    """(now-start)*100/start and that times 365 over the days held."""
    v = values.groupBy("symbol").agg(
        F.min_by("value", "ts").alias("start"), F.max_by("value", "ts").alias("end"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    pct = 100.0 * div(F.col("end") - F.col("start"), "start")
    return v.select("symbol", "days", pct.alias("profit_pct"), (pct * 365.0 * div(F.lit(1.0), "days")).alias("apy"))


# --- votes ----------------------------------------------------------------------


def time_weighted_power(tokens, lock_seconds, max_bps: int = 20000, full_seconds: int = 31536000):
    """floor(tokens * (1 + (max-1) * min(lock, full)/full))."""
    boost = 1.0 + (max_bps / 10000.0 - 1.0) * F.least(lock_seconds, F.lit(full_seconds)) / full_seconds
    return F.floor(tokens * boost).cast("long")


def quadratic_power(tokens):
    return F.floor(F.sqrt(tokens)).cast("long")


def cast_power(tokens, lock_remaining):
    """Remaining lock adds up to 2x, linear over 365 days, truncated."""
    bonus = 1.0 + F.greatest(lock_remaining, F.lit(0)) / (365.0 * 86400.0)
    return F.floor(tokens * bonus).cast("long")


def tally(votes: DataFrame, quorum: int = 20, threshold: int = 50, basis: str = "yes_no") -> DataFrame:
    """One vote per voter and proposal counts (the first).

    Any veto fails; below quorum fails; the yes share is an integer floor over yes+no,
    supply or all votes. ``votes`` has proposal, voter, ts, choice, power, supply.
    """
    first = votes.groupBy("proposal", "voter").agg(
        F.min_by(F.struct("choice", "power"), F.struct("ts", "vote_id")).alias("v"), F.max("supply").alias("supply"))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("v.choice") == k, F.col("v.power"))), F.lit(0))
    t = first.groupBy("proposal").agg(
        part("yes").alias("yes"), part("no").alias("no"), part("abstain").alias("abstain"), part("veto").alias("veto"),
        F.max("supply").alias("supply"))
    cast = F.col("yes") + F.col("no") + F.col("abstain")
    base = {"yes_no": F.col("yes") + F.col("no"), "supply": F.col("supply"), "votes": cast}[basis]
    quorate = cast >= F.floor(F.col("supply") * quorum / 100)
    share = F.when(base > 0, F.floor(F.col("yes") * 100 / base))
    return t.select(
        "proposal", "yes", "no", "abstain", "veto",
        ((F.col("veto") == 0) & quorate).alias("quorum_achieved"),
        ((F.col("veto") == 0) & quorate & F.coalesce(share >= threshold, F.lit(False))).alias("threshold_achieved"),
        F.coalesce(100.0 * div(cast, "supply"), F.lit(0.0)).alias("participation_pct"))

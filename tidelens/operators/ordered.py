"""Rows of all keys in one order, dealt in ranges: exact numbers, ranks and running values without a task for a key.

``lay_out`` sorts all rows by key and order over even ranges (sampled), so a key with most of the rows lies in many of them
and many keys may share one. Equal rows are told apart by where they were read, so a value that half of the rows hold is cut
as well. What crosses from range to range is one row for each key and range. The laid-out rows are written to the shared
folder: every later use sees the same ranges, also after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WITHIN = 33  # bits of a row's place inside its range


def lay_out(df: DataFrame, keys: list[str], order: list, ties: bool = False) -> DataFrame:
    """Adds ``_at`` (rises in order over all ranges) and ``_part`` (the range). ``ties``: rows may be equal in keys and order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*keys, *order]
    if ties:  # equal rows are parted by where they were read
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        cols.append("_tie")
    x = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(x.drop("_tie")).withColumn("_part", F.shiftright("_at", WITHIN))


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _joined(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Joins what a key and range carry; null keys meet."""
    named = parts.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "_part"]})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part") == F.col("_k__part")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(named, cond).drop(*[f"_k_{k}" for k in [*keys, "_part"]])


def numbered(df: DataFrame, keys: list[str], order: list, ties: bool = False) -> DataFrame:
    """``_rn`` = 1, 2, ... of each key: a row's place in its range, less where the key starts there, and the rows of earlier ranges."""
    x = lay_out(df, keys, order, ties)
    per = x.groupBy(*keys, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    per = per.select(*keys, "_part", (F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)) - F.col("_from") + 1).alias("_shift"))
    return _joined(x, per, keys).withColumn("_rn", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def last_known(df: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """``out``: the last ``value`` that is not null at or before each row of its key."""
    x = lay_out(df, keys, order)
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    tails = x.groupBy(*keys, "_part").agg(F.max_by(out, "_at").alias("_t"))
    carry = tails.select(*keys, "_part", F.last("_t", ignorenulls=True).over(_earlier(keys)).alias("_c"))
    return _joined(x, carry, keys).withColumn(out, F.coalesce(out, "_c")).drop("_c", "_at", "_part")


def floored_sum(df: DataFrame, keys: list[str], order: list, step: str, out: str) -> DataFrame:
    """``out``: the sum of ``step`` up to each row of its key, held at 0 from below at every row.

    With S the plain sum this is S - min(0, least S so far). A range hands on its sum and its least sum, in one pass."""
    x = lay_out(df, keys, order)
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_s", F.sum(step).over(inside)).withColumn("_m", F.min("_s").over(inside))
    tails = x.groupBy(*keys, "_part").agg(F.max_by("_s", "_at").alias("_ts"), F.min("_s").alias("_tm"))
    tails = tails.withColumn("_cs", F.coalesce(F.sum("_ts").over(_earlier(keys)), F.lit(0)))
    carry = tails.select(*keys, "_part", "_cs", F.least(F.coalesce(F.min(F.col("_cs") + F.col("_tm")).over(_earlier(keys)), F.lit(0)), F.lit(0)).alias("_cm"))
    y = _joined(x, carry, keys)
    s = F.col("_cs") + F.col("_s")
    return y.withColumn(out, s - F.least(F.col("_cm"), F.col("_cs") + F.col("_m"), F.lit(0))).drop("_s", "_m", "_cs", "_cm", "_at", "_part")

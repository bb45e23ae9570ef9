"""OHLCV bars from ticks, resampling, candle normalisation and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import div, json_num
from ..operators.series import number_rows
from .tables import table

# Sampling grid (fixed values): name -> width in seconds; months have no fixed width.
GRID_SECONDS = {"1s": 1, "1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "4h": 14400, "1d": 86400,
                "1w": 604800}
BUCKET_BARS = 4096


def bucket_of(ts, interval: str):
    """Start of the grid cell; weeks start on Monday, months are calendar months."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if interval == "1mo":
        return F.date_trunc("month", ts)
    if interval == "1w":
        return F.date_trunc("week", ts)
    width = GRID_SECONDS[interval]
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (width * 1000000)) * width)


def bars_from_ticks(ticks: DataFrame, interval: str = "1h") -> DataFrame:
    """``ticks``: symbol, ts, price, volume, tie. Partial aggregation runs before the shuffle."""
    order = F.struct("ts", "tie")
    return ticks.groupBy("symbol", bucket_of("ts", interval).alias("cell")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("cell", "ts")


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Coarser bars from finer ones."""
    return bars.groupBy("symbol", bucket_of("ts", interval).alias("cell")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("cell", "ts")


def numbered(bars: DataFrame, interval: str = "1h") -> DataFrame:
    """Number bars on the grid: a bucket covers at most BUCKET_BARS grid cells."""
    width = GRID_SECONDS.get(interval, 2592000) * BUCKET_BARS
    return number_rows(bars, ("symbol",), ("ts",), F.floor(F.unix_seconds("ts") / width))


def normalise_candles(raw: DataFrame) -> DataFrame:
    """String candles (symbol, open_time, open, high, low, close, volume) to typed bars.

    ``open_time`` is an epoch in milliseconds or seconds; the size tells which.
    """
    t = F.col("open_time").cast("long")
    ts = F.when(t >= 100000000000, F.timestamp_millis(t)).otherwise(F.timestamp_seconds(t))
    nums = [F.col(k).try_cast("double").alias(k) for k in ("open", "high", "low", "close", "volume")]
    return raw.select("symbol", ts.alias("ts"), *nums)


BAR_SCHEMA = "symbol STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def read_bar_file(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, least: int = 1) -> DataFrame:
    """Bars of a CSV or Parquet file (by suffix) inside an inclusive range of time, in order; fewer than ``least`` rows are an error.

    The schema is declared, the range reaches the scan, and only ``least`` rows are looked at to know that there are enough."""
    reader = spark.read.schema(BAR_SCHEMA)
    if path.endswith(".csv"):
        bars = reader.option("header", True).csv(path)
    elif path.endswith(".parquet"):
        bars = reader.parquet(path)
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")
    if start:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        bars = bars.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    if bars.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows in {path}")
    return bars


def store_prices(bars: DataFrame, folder: str, interval: str) -> None:
    """Bars under ``interval=.../day=...``, so that a range of time lists only its own folders. Rows are dealt in ranges of day, symbol
    and time: a day of many symbols is written by several tasks, a task writes few days."""
    bars.withColumn("day", F.to_date("ts")).repartitionByRange("day", "symbol", "ts").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/interval={interval}")


def read_prices(spark: SparkSession, folder: str, asset: str, interval: str, start: str, end: str) -> DataFrame:
    """Stored bars of an asset in an inclusive range; days outside it are pruned before they are listed as files."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    stored = spark.read.schema(f"{BAR_SCHEMA}, day DATE").parquet(f"{folder}/interval={interval}")
    return stored.filter(F.col("day").between(F.to_date(lo), F.to_date(hi)) & F.col("ts").between(lo, hi) & (F.col("symbol") == asset)).drop("day")


def panel(series: DataFrame, assets: list[str], value: str) -> DataFrame:
    """One column per asset; the asset list is given, so no distinct pass and a fixed width."""
    return series.groupBy("ts").pivot("symbol", assets).agg(F.first(value))


def event_ticks(spark: SparkSession, root: str) -> DataFrame:
    ev = table(spark, root, "events")
    return ev.select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        json_num("props", "$.k").alias("volume"), F.col("event_id").alias("tie"),
    )


def event_bars(spark: SparkSession, root: str, interval: str = "1h") -> DataFrame:
    return bars_from_ticks(event_ticks(spark, root), interval)


def brand_bars(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars per brand from line items: price per unit, volume in units."""
    li, part = table(spark, root, "lineitem"), table(spark, root, "part")
    ticks = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts"),
        div("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("tie"),
    )
    return bars_from_ticks(ticks, "1d")

"""Structured Streaming jobs: ingestion, refreshes, indexing, alerts, scoring. Streams whose result depends on time are in ``stateful``.

Every job is a function from a streaming DataFrame to a streaming DataFrame; ``run``
starts it with a file sink. State is bounded by a watermark, and sinks are idempotent:
a batch writes its own folder, so a repeated batch replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from ..sources import logs
from ..sources.keyed import KeyedTable
from ..sources.tables import SCHEMAS

LOOKBACK = "24 hours"


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a file stream. A pattern finds either; a plain path has to be a folder."""
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", 8).parquet(f"{root}/{{{name}}}.parquet")


def run(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, mark: dict[str, Column] | None = None):
    """Runs a job until all that is there is done, however long that takes, and returns (folder, query).

    Each micro-batch lands in ``batch=<id>``; ``each`` is the per-batch handler. ``mark`` (aggregates of a batch) keeps a
    progress row for each batch beside the data. A failed stream raises.
    """
    base = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{base}/data/batch={number}")
        if mark:
            batch.agg(*[c.alias(n) for n, c in mark.items()]).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return base, q


def results(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/data")


def newest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An update-mode sink read back: the last batch that touched a key wins."""
    rest = [n for n in rows.columns if n not in keys and n != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


# --- jobs ------------------------------------------------------------------------


def ingest_posts(posts: DataFrame, late: str = LOOKBACK) -> DataFrame:
    """Each (post, platform) once; posts more than ``late`` behind the newest one are dropped (``stateful.Job`` counts them)."""
    return posts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["post_id", "platform"])


def portfolio_refresh(orders: DataFrame) -> DataFrame:
    return orders.groupBy("portfolio").agg(F.sum("amount").alias("value"), F.count(F.lit(1)).alias("orders"), F.max("ts").alias("ts"))


def index_signals(transactions: DataFrame) -> DataFrame:
    """Submitted signals of a log stream."""
    return logs.events(transactions, "SignalSubmitted", logs.SIGNAL_SUBMITTED).filter("signal_id IS NOT NULL").withColumn("ts", F.timestamp_seconds("timestamp"))


def into_table(stream: DataFrame, table: KeyedTable, state: str, writer: str) -> None:
    """Merges a stream into a keyed table until all that is there is done. A batch that is sent again after a failure is merged once."""
    q = stream.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, writer, number)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def retention_loop(spark: SparkSession, table: KeyedTable, clock: str, state: str, days: int) -> None:
    """At each heartbeat (daily, written by ``stateful.tick``) rows older than ``days`` leave the table and their files are deleted."""
    def tidy(batch: DataFrame, number: int) -> None:
        cutoff = batch.agg((F.max("ts") - F.make_dt_interval(F.lit(days))).cast("string").alias("at")).first()["at"]
        if cutoff:
            table.drop_before(cutoff)
            table.vacuum()

    beats = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(clock)
    beats.writeStream.foreachBatch(tidy).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def threshold_alerts(events: DataFrame, high: float = 100.0, danger: float = 200.0) -> DataFrame:
    """Stateless rules on each event."""
    return events.filter(F.col("value") > high).select(
        "event_id", "ts", "event_type", "value", F.when(F.col("value") > danger, "danger").otherwise("warning").alias("severity"))


def score(rows: DataFrame, model: Callable, inputs: list[str], keep: list[str], out: str = "prediction") -> DataFrame:
    """Applies a vectorised ``model(frame) -> values`` to Arrow batches; works on streams and tables."""
    def apply(batches):
        for pdf in batches:
            res = pdf[keep].copy()
            res[out] = model(pdf[inputs])
            yield res

    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField(out, T.DoubleType())])
    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(apply, schema)


def progress(spark: SparkSession, base: str, component: str) -> DataFrame:
    """Progress of a component over all its batches, from the rows that ``run`` keeps for each: rows, newest time and its id."""
    marks = spark.read.parquet(f"{base}/marks")
    return marks.groupBy(F.lit(component).alias("component")).agg(
        F.sum("input_rows").alias("input_rows"), F.max("newest.ts").alias("last_ts"), F.max("newest").alias("_n")).select("component", "input_rows", "last_ts", F.col("_n.id").alias("last_id"))

"""Streams with state of their own: balances in time order, expiring signals, chained windows.

A stream's clock is its watermark: the newest time seen less the lateness allowed. What is final up to there leaves the
stream, in append mode; rows behind it are dropped and counted (``dropped_rows``). A source that falls silent no longer
moves the clock, so heartbeats (rows of a time alone) join the rows: ``with_clock`` adds them, ``tick`` writes one, and
a last one closes a finite input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.expr import json_num
from ..operators import social
from ..session import shared_folder

BEAT = "is_beat"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- clock and runs -----------------------------------------------------------------


def with_clock(rows: DataFrame, folder: str, time: str, late: str) -> DataFrame:
    """``rows`` and the heartbeats of ``folder`` under one watermark of ``late`` behind the newest time."""
    beats = rows.sparkSession.readStream.schema(f"{time} timestamp").parquet(folder).withColumn(BEAT, F.lit(True))
    both = rows.withColumn(time, F.col(time).cast("timestamp")).withColumn(BEAT, F.lit(False)).unionByName(beats, allowMissingColumns=True)
    return both.withWatermark(time, late)


def without_beats(rows: DataFrame, time: str) -> DataFrame:
    """Heartbeats out, after they have moved the clock.

    A condition without the time is pushed below the watermark, where it would hide the heartbeats from it: each column is made to
    depend on the time, so that conditions that come later (also inferred ones) stay above."""
    far = 1 << 62
    kept = rows.filter(F.greatest(F.col(BEAT).cast("long") * F.lit(far), F.unix_micros(time)) < far).drop(BEAT)
    return kept.select(time, *[F.when(F.col(time).isNotNull(), F.col(c)).alias(c) for c in kept.columns if c != time])


def tick(spark: SparkSession, folder: str, time: str, at) -> None:
    """Writes the heartbeat ``at`` (a timestamp; None creates the folder)."""
    rows = spark.createDataFrame([] if at is None else [(at,)], f"{time} timestamp")
    rows.coalesce(1).write.mode("append").parquet(folder)


class Job:
    """A stream of one name with its folder of state, output and heartbeats; it goes on where it stopped."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None) -> None:
        self.spark, self.base = spark, base or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.clock, self.dropped, self.batches = f"{self.base}/clock", 0, 0

    def run(self, build: Callable[[str], DataFrame], time: str = "ts", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Starts or resumes ``build(clock folder)`` and runs until all that is there is done."""
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.base}/data/batch={number}")

        if not self._exists(self.clock):
            tick(self.spark, self.clock, time, None)
        conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.numRecentProgressUpdates": "10000"}
        before = {k: self.spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            stream = build(self.clock)
            self.schema = stream.schema
            q = stream.writeStream.outputMode("append").foreachBatch(each or write).option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.dropped += dropped_rows(q)
        self.batches += len(q.recentProgress)
        return q

    def close(self, build: Callable[[str], DataFrame], at, time: str = "ts") -> DataFrame:
        """Runs the stream, moves its clock to what the heartbeat ``at`` allows, and returns all it has put out."""
        self.run(build, time)
        tick(self.spark, self.clock, time, at)
        self.run(build, time)
        return self.output()

    def output(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/data").select(*self.schema.names)

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)


def dropped_rows(q: StreamingQuery) -> int:
    """Rows that came behind the watermark, over all stateful operators and batches of a run."""
    return sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])


# --- packed rows in state -------------------------------------------------------------


def pack(pdf: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(*parts: bytes) -> pd.DataFrame:
    return pd.concat([pa.ipc.open_stream(p).read_pandas() for p in parts], ignore_index=True)


def _micros(times: pd.Series) -> np.ndarray:
    return pd.to_datetime(times).to_numpy("datetime64[us]").astype(np.int64)


# --- balances -------------------------------------------------------------------------


class Balances(StatefulProcessor):
    """Rows of a vault wait in cells of time until the clock has passed a cell; then they are put in order and walked."""

    def __init__(self, cell_seconds: int) -> None:
        self.cell = cell_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cell bigint", "rows array<binary>")
        self.carry = handle.getValueState("carry", "cents bigint")
        self.next = handle.getValueState("next", "at bigint")

    def _wake(self, at: int) -> None:
        """One timer a vault: at the end of its first waiting cell."""
        if self.next.exists():
            if self.next.get()[0] <= at:
                return
            self.handle.deleteTimer(self.next.get()[0])
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf = pdf[~pdf[BEAT].astype(bool)]
            if not len(pdf):
                continue
            us = _micros(pdf["ts"])
            part = pd.DataFrame({"tx": pdf["tx"].to_numpy(np.int64), "us": us, "kind": pdf["kind"].to_numpy(), "cents": pdf["cents"].to_numpy(np.int64)})
            for cell, own in part.groupby(us // (self.cell * 1000)):
                held = list(self.waiting.getValue((int(cell),))[0]) if self.waiting.containsKey((int(cell),)) else []
                self.waiting.updateValue((int(cell),), ([bytes(h) for h in held] + [pack(own)],))
                first = int(cell) if first is None else min(first, int(cell))
        if first is not None:
            self._wake((first + 1) * self.cell)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        cells = sorted(c[0] for c in self.waiting.keys())
        self.next.clear()
        balance = self.carry.get()[0] if self.carry.exists() else 0
        for cell in cells:
            if (cell + 1) * self.cell > now:
                self._wake((cell + 1) * self.cell)
                break
            pdf = unpack(*map(bytes, self.waiting.getValue((cell,))[0])).sort_values(["us", "tx"], kind="stable")
            moved = np.where(pdf["kind"] == "deposit", pdf["cents"], np.where(pdf["kind"] == "withdrawal", -pdf["cents"], 0))
            run = balance + np.cumsum(moved)
            run -= np.minimum(np.minimum.accumulate(run), 0)  # never below zero, at every step
            self.waiting.removeKey((cell,))
            balance = int(run[-1])
            yield pd.DataFrame({"tx": pdf["tx"], "vault": key[0], "kind": pdf["kind"], "ts": pd.to_datetime(pdf["us"], unit="us"), "balance": run / 100.0})
        self.carry.update((balance,))

    def close(self) -> None:
        pass


def balances(ledger: DataFrame, clock: str, late: str, cell_seconds: int = 3600) -> DataFrame:
    """Balance after each transaction of a ledger stream (tx, vault, kind, amount, ts), floored at 0 at every step.

    A balance depends on the order in time, which files do not keep: rows wait until the watermark (``late`` behind the newest time)
    has passed their cell of ``cell_seconds``. State holds the rows of the cells still open, and one balance a vault.
    """
    rows = ledger.select("tx", "vault", "kind", (F.col("amount") * 100).cast("long").alias("cents"), "ts")
    keyed = with_clock(rows, clock, "ts", late)
    return keyed.groupBy("vault").transformWithStateInPandas(Balances(cell_seconds), "tx long, vault long, kind string, ts timestamp, balance double", "Append", "EventTime")


# --- expiry ---------------------------------------------------------------------------


class Expiry(StatefulProcessor):
    """Open signals and recent executions of the keys of a slot, as packed columns; a timer fires at the end of the life that ends first.

    Signals are columns (key, 1 if it is null, time, id, execution or -1), executions the first three of them."""

    def __init__(self, life_seconds: int) -> None:
        self.life = life_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.signals = handle.getValueState("signals", "rows binary")
        self.executions = handle.getValueState("executions", "rows binary")
        self.next = handle.getValueState("next", "at bigint")

    def _load(self, state, width: int) -> np.ndarray:
        return np.frombuffer(bytes(state.get()[0]) if state.exists() else b"", np.int64).reshape(width, -1)

    def _keep(self, state, rows: np.ndarray) -> None:
        state.update((rows.tobytes(),)) if rows.shape[1] else state.clear()

    def _wake(self, signals: np.ndarray) -> None:
        """One timer a slot: when the first of its signals ends."""
        if not signals.shape[1]:
            return
        at = int((signals[2].min() + self.life) // 1000 + 1)
        if self.next.exists():
            if self.next.get()[0] <= at:
                return
            self.handle.deleteTimer(self.next.get()[0])
        self.handle.registerTimer(at)
        self.next.update((at,))

    def _out(self, rows: np.ndarray, status: str) -> pd.DataFrame:
        key, none, us, number, at = rows
        key = pd.arrays.IntegerArray(key.copy(), none > 0) if none.any() else key
        at = np.where(at >= 0, at, np.iinfo(np.int64).min)  # NaT
        return pd.DataFrame({"signal": number, "key": key, "ts": us.astype("datetime64[us]"), "executed_at": at.astype("datetime64[us]"), "status": status})

    @staticmethod
    def _first(signals: np.ndarray, executions: np.ndarray) -> np.ndarray:
        """Time of the first execution of its key at or after each signal."""
        n, both = signals.shape[1], np.concatenate([signals[:3], executions], axis=1)
        is_execution = np.arange(both.shape[1]) >= n
        order = np.lexsort((is_execution, both[2], both[0], both[1]))
        row = both[:, order]
        near = np.where(is_execution[order], np.arange(len(order)), len(order))
        near = np.minimum.accumulate(near[::-1])[::-1]
        there = np.minimum(near, max(len(order) - 1, 0))
        own = (near < len(order)) & (row[0, there] == row[0]) & (row[1, there] == row[1])
        first = np.empty(len(order), np.int64)
        first[order] = np.where(own, row[2, there], np.iinfo(np.int64).max)
        return first[:n]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signals, executions = self._load(self.signals, 5), self._load(self.executions, 3)
        new_s, new_e = [signals[:, :0]], []
        for pdf in rows:
            pdf = pdf[~pdf[BEAT].astype(bool)]
            got = np.stack([*(pdf[c].to_numpy(np.int64) for c in ("key", "keyless")), _micros(pdf["ts"]), pdf["id"].to_numpy(np.int64), np.full(len(pdf), -1)])
            new_s.append(got[:, (pdf["kind"] == "signal").to_numpy()])
            new_e.append(got[:3, (pdf["kind"] == "execution").to_numpy()])
        fresh = np.concatenate(new_s, axis=1)
        if fresh.shape[1]:
            yield self._out(fresh, "pending")
        signals, executions = np.concatenate([signals, fresh], axis=1), np.concatenate([executions, *new_e], axis=1)
        first = self._first(signals, executions)
        hit = (first <= signals[2] + self.life) & ((signals[4] < 0) | (first < signals[4]))
        if hit.any():
            signals[4, hit] = first[hit]
            yield self._out(signals[:, hit], "executed")
        self._wake(fresh)
        # an execution can only meet signals at or before it, and none older than the clock will come
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(self.signals, signals)
        self._keep(self.executions, executions[:, executions[2] >= clock])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        signals = self._load(self.signals, 5)
        over = signals[2] + self.life < now
        lost = signals[:, over & (signals[4] < 0)]
        if lost.shape[1]:
            yield self._out(lost, "expired")
        self._keep(self.signals, signals[:, ~over])
        self.next.clear()
        self._wake(signals[:, ~over])

    def close(self) -> None:
        pass


def expiring(rows: DataFrame, clock: str, life_seconds: int, late: str, slots: int = 4096) -> DataFrame:
    """States of signals as they change, from a stream of (kind signal or execution, id, key, ts): pending at once, executed at the first
    execution of its key within ``life_seconds`` (again if an earlier one comes later), expired when the watermark passes its life.

    Keys share ``slots`` states by hash, each with one timer: what a state costs to open does not grow with the keys, and all keys
    of a slot are matched together. Rows more than ``late`` behind the newest one are dropped and counted."""
    timed = with_clock(rows.select("kind", "id", "key", "ts"), clock, "ts", late)
    whole = [F.coalesce("id", F.lit(-1)).cast("long").alias("id"), F.coalesce("key", F.lit(0)).cast("long").alias("key"), F.col("key").isNull().alias("keyless")]
    keyed = timed.select("kind", *whole, "ts", BEAT, F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot"))
    return keyed.groupBy("slot").transformWithStateInPandas(Expiry(life_seconds), "signal long, key long, ts timestamp, executed_at timestamp, status string", "Append", "EventTime")


def newest_states(changes: DataFrame) -> DataFrame:
    """The state each signal has reached: its first execution if there is one, else expired or pending."""
    out = changes.groupBy("signal", "key", "ts").agg(F.min("executed_at").alias("executed_at"), F.bool_or(F.col("status") == "expired").alias("_x"))
    return out.select("signal", "key", "ts", "executed_at", F.when(F.col("executed_at").isNotNull(), "executed").when(F.col("_x"), "expired").otherwise("pending").alias("status"))


# --- chained windows --------------------------------------------------------------------


def sliding_metrics(posts: DataFrame, clock: str, late: str, span: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Protocol metrics over the last 24 hours, every hour, as two chained aggregates: first one row an author, protocol and window,
    so that authors are counted exactly, then one a protocol and window. A window leaves the stream once, when it is final."""
    x = posts.withColumn("fud", social.is_fud(F.col("content"))).drop("content")
    rows = without_beats(with_clock(x, clock, "ts", late), "ts")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    authors = social.by_protocol(rows).groupBy("protocol", F.window("ts", span, step), "author").agg(
        F.count(F.lit(1)).alias("mentions"), F.sum(F.col("sentiment") * F.col("confidence")).alias("weighted"), F.sum("confidence").alias("weight"),
        F.sum("eng").alias("engagement"), one(F.col("sentiment") < -0.5).alias("negatives"), one(F.col("fud")).alias("fuds"))
    total = F.sum
    return authors.groupBy("protocol", "window").agg(
        total("mentions").alias("mention_count"), (total("weighted") / total("weight")).alias("sentiment_score"), total("engagement").alias("total_engagement"),
        F.count(F.lit(1)).alias("unique_authors"), (total("negatives") / total("mentions") > 0.3).alias("negative"),
        (total("fuds") / total("mentions") > 0.1).alias("fud_spread")).withColumn("window_start", F.col("window.start")).drop("window")


class DaySums(StatefulProcessor):
    """Final cells of a protocol come in order; those of the last day are kept, and each is put out with the sums up to it."""

    def __init__(self, span_seconds: int) -> None:
        self.span = span_seconds * 1_000_000

    def init(self, handle) -> None:
        self.cells = handle.getValueState("cells", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pd.DataFrame({"us": _micros(p["cell"]), "n": p["n"].to_numpy(np.int64), "v": p["v"].to_numpy(float)}) for p in rows]).sort_values("us")
        held = unpack(bytes(self.cells.get()[0])) if self.cells.exists() else new.iloc[:0]
        both = pd.concat([held, new], ignore_index=True)
        us = both["us"].to_numpy()
        n, v = (np.concatenate([[0], np.cumsum(np.nan_to_num(both[c].to_numpy()))]) for c in ("n", "v"))
        at = np.arange(len(held), len(both))
        low = np.searchsorted(us, us[at] - self.span, "right")
        yield pd.DataFrame({"protocol": key[0], "cell": pd.to_datetime(us[at], unit="us"), "transactions_24h": n[at + 1] - n[low], "volume_24h": v[at + 1] - v[low]})
        self.cells.update((pack(both[us > us[-1] - self.span]),))

    def close(self) -> None:
        pass


def market_refresh(events: DataFrame, clock: str, late: str, span_seconds: int = 86400, cell: str = "5 minutes") -> DataFrame:
    """24-hour sums of each protocol at every 5-minute cell that has events: an aggregate into cells, then state with the last day of them.

    A 24-hour window sliding by 5 minutes would copy each event or cell 288 times. A cell leaves the stream once, when it is final."""
    rows = without_beats(with_clock(events.select("protocol", "ts", json_num("metadata", "$.k").alias("k")), clock, "ts", late), "ts")
    cells = rows.groupBy("protocol", F.window("ts", cell).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("v"))
    timed = cells.select("protocol", "n", "v", F.col("w.start").alias("cell"), F.window_time("w").alias("t"))
    return timed.groupBy("protocol").transformWithStateInPandas(
        DaySums(span_seconds), "protocol string, cell timestamp, transactions_24h long, volume_24h double", "Append", "EventTime")

"""Keyed tables: overlapping and dying writers, retention on files. Log source: each event once over stops."""

import os

import pytest
from pyspark.sql import functions as F

from tidelens.sources import log_source
from tidelens.sources.keyed import KeyedTable
from tidelens.streaming import jobs
from tidelens.streaming.stateful import tick

ROWS = "model long, signal long, v long, ts timestamp"


def rows(spark, low, high):
    return spark.range(low, high).select((F.col("id") % 5).alias("model"), (F.col("id") % 40).alias("signal"), F.col("id").alias("v"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))


def table(spark, path):
    return KeyedTable(spark, str(path), ["model", "signal"], ["v"], time="ts", buckets=4)


def content(df):
    got = [(r["model"], r["signal"], r["v"]) for r in df.collect()]
    assert len({g[:2] for g in got}) == len(got)
    return set(got)


def least(*ranges):
    out = {}
    for low, high in ranges:
        for i in range(low, high):
            k = (i % 5, i % 40)
            out[k] = min(out.get(k, i), i)
    return {(*k, v) for k, v in out.items()}


def parquet_files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_overlapping_writers_leave_each_key_once(spark, tmp_path):
    a, b = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    a.upsert(rows(spark, 30, 60))
    calls = []

    def other():
        if not calls:
            calls.append(1)
            b.upsert(rows(spark, 0, 45))

    assert a.upsert(rows(spark, 20, 90), before_commit=other) == 3  # b took number 2 in between
    assert content(a.read()) == least((30, 60), (20, 90), (0, 45)) and content(a.read(1)) == least((30, 60))


def test_a_dying_writer_leaves_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.upsert(rows(spark, 0, 50), "w", 7)

    def die():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        t.upsert(rows(spark, 0, 300), "w", 8, before_commit=die)
    assert t.version() == 1 and content(t.read()) == least((0, 50))
    t.upsert(rows(spark, 0, 300), "w", 8)
    assert t.upsert(rows(spark, 0, 999), "w", 8) == 2  # sent again: not merged again
    assert content(t.read()) == least((0, 300))
    before = len(parquet_files(tmp_path / "t"))
    t.vacuum(grace_seconds=0)
    assert len(parquet_files(tmp_path / "t")) < before and content(t.read()) == least((0, 300))
    assert len(parquet_files(tmp_path / "t")) == len(t.manifest()["cells"])


def test_retention_deletes_files(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["v"], ["v"], time="ts", buckets=2)
    t.upsert(rows(spark, 0, 24 * 5).unionByName(spark.createDataFrame([(1, 1, 9999, None)], ROWS)))
    day = lambda d: F.timestamp_seconds(F.lit(d * 86400))
    ticks = spark.range(1).select(*[day(d).alias(f"d{d}") for d in (3, 4)]).first()
    for at in ticks:
        tick(spark, str(tmp_path / "clock"), "ts", at)
        jobs.retention_loop(spark, t, str(tmp_path / "clock"), str(tmp_path / "state"), 2)
    left = {r["v"] for r in t.read().collect()}
    assert left == {*range(48, 120), 9999}
    held = spark.read.parquet(*parquet_files(tmp_path / "t" / "data"))
    assert {r["v"] for r in held.collect()} == left  # nothing older is on disk
    t.drop_before("1970-01-03 12:00:00")  # inside a day: that cell is written anew
    assert {r["v"] for r in t.read().collect()} == {*range(60, 120), 9999}


def test_null_and_repeated_keys_and_an_empty_batch(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    with pytest.raises(ValueError):
        t.read()
    t.upsert(spark.createDataFrame([], ROWS))
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(None, 1, 3, None), (None, 1, 2, None), (1, None, 5, None)], ROWS))
    assert sorted(map(str, content(t.read()))) == ["(1, None, 5)", "(None, 1, 2)"]


def test_log_source_goes_on_behind_the_last_event(spark, tmp_path):
    tx = spark.range(230).select((F.col("id") / 7).cast("long").alias("block"), F.format_string("s%05d", "id").alias("signature"),
                                 F.when(F.col("id") % 50 == 0, "Err").alias("err"), F.array(F.lit("a"), F.concat(F.lit("b"), "id")).alias("logs"))
    got, fail = [], [True]

    def take(batch, number):
        found = [(number, r["signature"]) for r in batch.collect()]
        if fail and number == 1:
            fail.clear()
            raise RuntimeError("killed in a batch")
        got.extend(found)

    def run():
        q = log_source.read_logs(spark, str(tmp_path / "logs")).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    log_source.archive(tx.filter("block < 10"), str(tmp_path / "logs"), 5)
    run()
    log_source.archive(tx.filter("block >= 10 AND block < 30"), str(tmp_path / "logs"), 5)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    log_source.archive(tx.filter("block >= 30"), str(tmp_path / "logs"), 5)
    run()
    run()
    assert sorted(s for _, s in got) == [f"s{i:05d}" for i in range(230)]
    assert {n for n, _ in got} == {0, 1, 2}

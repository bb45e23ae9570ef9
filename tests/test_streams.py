"""Streams with state: shuffled files over many batches, late rows, stop and restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelens.operators.vaults import running_balance
from tidelens.streaming import stateful as S

DAY = dt.datetime(2024, 1, 1)
LEDGER = "tx long, vault long, kind string, amount decimal(18,2), ts timestamp"
MOVES = "kind string, id long, key long, ts timestamp"


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def files(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ledger_rows(n=400, seed=3):
    rng = random.Random(seed)
    kinds = ["deposit", "withdrawal", "fee"]
    return [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice(kinds), str(rng.randrange(1, 100_000) / 100), DAY + dt.timedelta(minutes=rng.randrange(5000))) for i in range(n)]


def decimals(rows):
    from decimal import Decimal

    return [(a, b, c, Decimal(d), e) for a, b, c, d, e in rows]


def test_balances_of_shuffled_files_equal_the_batch_and_go_on_after_a_stop(spark, tmp_path):
    rows = decimals(ledger_rows())
    random.Random(1).shuffle(rows)
    job = S.Job(spark, "t", str(tmp_path / "job"))
    build = lambda clock: S.balances(files(spark, tmp_path / "in", LEDGER), clock, "10 days", 3600)
    for part in range(4):
        write(spark, tmp_path / "in", rows[part * 50:part * 50 + 50], LEDGER)
    job.run(build)
    assert job.output().count() == 0  # nothing is final yet
    for part in range(4, 8):
        write(spark, tmp_path / "in", rows[part * 50:part * 50 + 50], LEDGER)
    out = job.close(build, DAY + dt.timedelta(days=20))
    want = running_balance(spark.createDataFrame(rows, LEDGER))
    assert {(r["tx"], r["vault"], r["balance"]) for r in out.collect()} == {(r["tx"], r["vault"], r["balance"]) for r in want.collect()}
    assert out.count() == len(rows) and job.dropped == 0 and job.batches >= 8


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    job = S.Job(spark, "t", str(tmp_path / "job"))
    build = lambda clock: S.balances(files(spark, tmp_path / "in", LEDGER), clock, "1 hour", 600)
    hour = lambda h: DAY + dt.timedelta(hours=h)
    for k, rows in enumerate([[(1, 1, "deposit", "5", hour(1))], [(2, 1, "withdrawal", "2", hour(10))], [(3, 1, "deposit", "100", hour(2)), (4, 1, "deposit", "1", hour(9.5))]]):
        write(spark, tmp_path / "in", decimals(rows), LEDGER)
        job.run(build)
    out = {r["tx"]: r["balance"] for r in job.close(build, hour(48)).collect()}
    assert out == {1: 5.0, 4: 6.0, 2: 4.0} and job.dropped == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_signals_expire_by_the_clock(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [("signal" if rng.random() < 0.5 else "execution", i, rng.randrange(6), DAY + dt.timedelta(minutes=rng.randrange(3000))) for i in range(150)]
    now = max(r[3] for r in rows)
    life = 5 * 3600
    want = {}
    for kind, i, key, ts in rows:
        if kind == "signal":
            hits = [t for k, _, y, t in rows if k == "execution" and y == key and ts <= t <= ts + dt.timedelta(seconds=life)]
            want[i] = (min(hits), "executed") if hits else (None, "expired" if ts + dt.timedelta(seconds=life) < now else "pending")
    rng.shuffle(rows)
    job = S.Job(spark, "t", str(tmp_path / "job"))
    build = lambda clock: S.expiring(files(spark, tmp_path / "in", MOVES), clock, life, "3 days")
    for part in range(3):
        write(spark, tmp_path / "in", rows[part * 50:part * 50 + 50], MOVES)
    changes = job.close(build, now + dt.timedelta(days=3))
    got = {r["signal"]: (r["executed_at"], r["status"]) for r in S.newest_states(changes).collect()}
    assert got == want and job.dropped == 0
    assert changes.filter("status = 'pending'").count() == len(want)  # a signal is seen at once


def test_many_keys_share_few_states_and_timers(spark, tmp_path):
    rng = random.Random(4)
    big = 1 << 60  # would lose digits as a double
    rows = [("signal" if rng.random() < 0.5 else "execution", big + i, rng.choice([None, *range(big, big + 200)]), DAY + dt.timedelta(minutes=rng.randrange(3000))) for i in range(900)]
    life, now, want = 5 * 3600, max(r[3] for r in rows), {}
    for kind, i, key, ts in rows:
        if kind == "signal":
            hits = [t for k, _, y, t in rows if k == "execution" and y == key and ts <= t <= ts + dt.timedelta(seconds=life)]
            want[i] = (key, min(hits), "executed") if hits else (key, None, "expired" if ts + dt.timedelta(seconds=life) < now else "pending")
    write(spark, tmp_path / "in", rows, MOVES)
    job = S.Job(spark, "t", str(tmp_path / "job"))
    build = lambda clock: S.expiring(files(spark, tmp_path / "in", MOVES), clock, life, "3 days", 4)
    q = job.run(build)
    assert 0 < sum(s["numRowsTotal"] for s in q.recentProgress[-1]["stateOperators"]) <= 4 * 6  # was some for each key and signal
    got = {r["signal"]: (r["key"], r["executed_at"], r["status"]) for r in S.newest_states(job.close(build, now + dt.timedelta(days=3))).collect()}
    assert got == want and job.dropped == 0


def test_market_cells_leave_once_and_late_events_are_counted(spark, tmp_path):
    schema = "protocol string, ts timestamp, metadata string"
    rng = random.Random(5)
    rows = [(rng.choice("ab"), DAY + dt.timedelta(minutes=rng.randrange(4000)), '{"k": 2}') for _ in range(300)]
    rows.sort(key=lambda r: r[1])
    rows += [("a", DAY + dt.timedelta(minutes=7), '{"k": 2}')]  # two days late
    job = S.Job(spark, "t", str(tmp_path / "job"))
    build = lambda clock: S.market_refresh(files(spark, tmp_path / "in", schema), clock, "1 day")
    for part in range(0, 301, 100):
        write(spark, tmp_path / "in", rows[part:part + 100], schema)
        job.run(build)
    out = job.close(build, DAY + dt.timedelta(days=30)).collect()
    cell = lambda t: t - dt.timedelta(minutes=t.minute % 5, seconds=t.second)
    want = {}
    for p, t, _ in rows[:300]:
        n = sum(q == p and cell(t) - dt.timedelta(hours=24) < cell(u) <= cell(t) for q, u, _ in rows[:300])
        want[p, cell(t)] = (n, 2.0 * n)
    assert {(r["protocol"], r["cell"]): (r["transactions_24h"], r["volume_24h"]) for r in out} == want and len(out) == len(want)
    assert job.dropped == 1


def test_a_table_of_one_file_or_of_a_folder_of_files_is_streamed_whole(spark, tmp_path):
    from tidelens.streaming.jobs import run, stream_table

    rows = spark.createDataFrame([(i, i % 2, i % 3) for i in range(40)], "doc_id long, quality int, toxic int")
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "labels.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "spare"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "spare").glob("part-*.parquet")).rename(tmp_path / "one" / "labels.parquet")
    for kind in ("one", "many"):
        base, _ = run(stream_table(spark, str(tmp_path / kind), "labels"), kind)
        assert sorted(r["doc_id"] for r in spark.read.parquet(f"{base}/data").collect()) == list(range(40))

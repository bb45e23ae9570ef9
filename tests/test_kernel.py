"""The series kernel must give the same result whatever the block size."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import T0, assert_rows, hours
from tidelens.functions.rolling import mean, std
from tidelens.operators import machines, quality
from tidelens.operators.joins import asof
from tidelens.operators.quantile import exact_quantiles
from tidelens.operators.replay import replay
from tidelens.operators.series import affine_scan, blocks, number_rows, prefix, unblock


def series(spark, n=50, keys=("a", "b")):
    rows = [(k, hours(i * 37 % n * 5), float((i * 7919) % 101)) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double")


def test_number_rows_follows_time_across_buckets(spark):
    df = number_rows(series(spark), bucket=F.date_trunc("day", "ts"))
    for k in "ab":
        rows = df.filter(F.col("symbol") == k).orderBy("ts").collect()
        assert [r["_rn"] for r in rows] == list(range(1, 51))


@pytest.mark.parametrize("rows", [6, 7, 16, 4096])
def test_blocked_frames_equal_whole_series(spark, rows):
    num = number_rows(series(spark), bucket=F.date_trunc("day", "ts"))
    got = unblock(blocks(num, 5, rows=rows).withColumns({"m": mean("x", 6), "s": std("x", 6)})).orderBy("symbol", "_rn").collect()
    for k in "ab":
        part = [r for r in got if r["symbol"] == k]
        x = [r["x"] for r in part]
        for i, r in enumerate(part):
            if i < 5:
                assert r["m"] is None and r["s"] is None
            else:
                assert abs(r["m"] - np.mean(x[i - 5:i + 1])) < 1e-9
                assert abs(r["s"] - np.std(x[i - 5:i + 1], ddof=1)) < 1e-9


@pytest.mark.parametrize("rows,fan", [(3, 2), (5, 3), (512, 512)])
def test_affine_scan_equals_loop(spark, rows, fan, monkeypatch):
    from tidelens.operators import series as kernel

    monkeypatch.setattr(kernel, "SCAN_TOP", 2)
    num = number_rows(series(spark), bucket=F.date_trunc("day", "ts"))
    factor = 0.5 + F.col("x") / 300.0
    got = affine_scan(num, {"c": (0.8, F.col("x")), "v": (factor, F.col("x")), "t": (1.0, F.col("x")), "z": (0.0, F.col("x"))}, rows=rows, fan=fan)
    got = got.orderBy("symbol", "_rn").collect()
    for k in "ab":
        c = v = t = 0.0
        for r in (r for r in got if r["symbol"] == k):
            c, v, t = 0.8 * c + r["x"], (0.5 + r["x"] / 300.0) * v + r["x"], t + r["x"]
            assert_rows([(r["c"], r["v"], r["t"], r["z"])], [(c, v, t, r["x"])], 1e-6)


@pytest.mark.parametrize("rows", [3, 8, 4096])
@pytest.mark.parametrize("reverse", [False, True])
def test_prefix_equals_loop(spark, rows, reverse):
    num = number_rows(series(spark), bucket=F.date_trunc("day", "ts")).withColumn("h", F.when(F.col("x") % 3 == 0, F.col("x")))
    specs = {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "f": ("last", F.col("h"))}
    got = prefix(num, specs, rows=rows, reverse=reverse).orderBy("symbol", "_rn").collect()
    for k in "ab":
        part = [r for r in got if r["symbol"] == k]
        s, hi, lo, f = 0.0, -1e9, 1e9, None
        for r in reversed(part) if reverse else part:
            s, hi, lo, f = s + r["x"], max(hi, r["x"]), min(lo, r["x"]), f if r["h"] is None else r["h"]
            assert_rows([(r["s"], r["hi"], r["lo"], r["f"])], [(s, hi, lo, f)])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300))
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    for accuracy in (20, 10_000):  # a small accuracy exercises the bracket, a large one the whole group
        r = exact_quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 0.9, 1.0], list("abcde"), accuracy=accuracy).first()
        want = np.quantile(np.array(values, dtype=float), [0.0, 0.05, 0.5, 0.9, 1.0])
        assert np.allclose([r[c] for c in "abcde"], want)
        p = exact_quantiles(df, ["k"], "v", [0.05], ["a"], "position", accuracy=accuracy).first()
        assert p["a"] == sorted(values)[int(len(values) * 0.05)]


def test_exact_quantiles_with_one_hot_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    r = exact_quantiles(df, [], "v", [0.25, 0.5, 0.99], list("abc"), accuracy=100).first()
    want = np.quantile([7.0 if i % 3 else float(i) for i in range(5000)], [0.25, 0.5, 0.99])
    assert np.allclose([r[c] for c in "abc"], want)


def test_few_large_groups_are_not_dealt_by_group(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 997).cast("double").alias("v"), F.lit(1.0).alias("w"))
    q = exact_quantiles(df, ["k"], "v", [0.25, 0.5], list("ab"))
    shares = quality.outlier_share(df, ["v", "w"], 0.1)
    for x in (q, shares):
        assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["column"], r["outliers"]) for r in shares.collect()) == [("v", 8_000), ("w", 0)]
    assert np.allclose([r["a"] for r in q.orderBy("k").collect()], [np.quantile([i % 997 for i in range(k, 20_000, 2)], 0.25) for k in (0, 1)])


@pytest.mark.parametrize("rows", [4, 9, 100000])
def test_replay_is_block_independent(spark, rows):
    num = number_rows(series(spark, 60), bucket=F.date_trunc("day", "ts"))
    num = num.select("symbol", "_rn", (F.col("x") - 50).alias("d"), F.col("x").alias("volume"), F.lit(120.0).alias("bucket"))
    out = replay(num, machines.VolumeBuckets("d", "v"), ["d", "volume", "bucket"], {"v": T.DoubleType()}, rows=rows)
    got = {(r["symbol"], r["_rn"]): r["v"] for r in out.collect()}
    for k in "ab":
        part = num.filter(F.col("symbol") == k).orderBy("_rn").collect()
        net = full = 0.0
        for r in part:
            want = 0.0
            if r["_rn"] > 1:
                net += r["volume"] if r["d"] > 0 else -r["volume"] if r["d"] < 0 else 0.0
                full += r["volume"]
                if full >= 120:
                    want, net, full = abs(net) / full, 0.0, 0.0
            assert abs(got[(k, r["_rn"])] - want) < 1e-12


def test_asof_takes_last_row_at_or_before(spark):
    s = spark.createDataFrame([("a", hours(1), 1.0), ("a", hours(3), 3.0), ("b", hours(9), 9.0)], "k string, ts timestamp, p double")
    p = spark.createDataFrame([("a", hours(0), 0), ("a", hours(1), 1), ("a", hours(2), 2), ("a", hours(30), 30), ("b", hours(8), 8)], "k string, ts timestamp, i int")
    got = {r["i"]: r["p"] for r in asof(p, s, "k", "ts", ["p"]).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 30: 3.0, 8: None}


def test_a_hot_key_and_a_hot_value_are_cut_into_even_ranges(spark):
    from tidelens.operators import ordered

    # nine tenths of the rows in one key, and half of all in one second of it
    rows = [("hot", T0 + dt.timedelta(seconds=max(i - 1500, 0)), i) for i in range(2700)] + [(None if i % 2 else "b", T0 + dt.timedelta(days=i), i) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, i long").repartition(5)
    sizes = [r["count"] for r in ordered.lay_out(df, ["symbol"], ["ts"], ties=True).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.6 * 3000 / 4
    got = ordered.numbered(df, ["symbol"], ["ts", "i"])
    want = {(s, i): k for s in ("hot", "b", None) for k, i in enumerate((i for t, _, i in sorted(rows, key=lambda r: (r[1], r[2])) if t == s), 1)}
    assert {(r["symbol"], r["i"]): r["_rn"] for r in got.collect()} == want
    ranks = ordered.numbered(df.withColumn("v", F.lit(1)), ["v"], ["v"], ties=True).agg(F.count("*"), F.count_distinct("_rn"), F.min("_rn"), F.max("_rn")).first()
    assert tuple(ranks) == (3000, 3000, 1, 3000)


def test_running_values_cross_ranges(spark):
    from tidelens.operators import ordered

    steps = [(i * 7919) % 41 - 21 for i in range(900)]
    rows = [("a" if i % 9 else "b", i, s, float(s) if s % 11 == 0 else None) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "k string, i long, s long, v double").repartition(3)
    level, last, want = {}, {}, {}
    for k, i, s, v in rows:
        level[k] = max(level.get(k, 0) + s, 0)
        last[k] = v if v is not None else last.get(k)
        want[i] = (level[k], last[k])
    x = ordered.last_known(ordered.floored_sum(df, ["k"], ["i"], "s", "level"), ["k"], ["i"], "v", "last")
    assert {r["i"]: (r["level"], r["last"]) for r in x.collect()} == want
    assert ordered.numbered(df.limit(0), ["k"], ["i"]).count() == 0


def test_quantiles_narrow_until_few_values_are_left(spark, monkeypatch):
    from tidelens.operators import quantile

    rng = np.random.default_rng(3)
    passes, narrowed = [], quantile._narrowed
    monkeypatch.setattr(quantile, "_narrowed", lambda *a: passes.append((out := narrowed(*a))[1]) or out)
    for values in (rng.exponential(size=40_000) ** 4, np.where(rng.random(40_000) < 0.5, 3.0, rng.integers(0, 50, 40_000).astype(float))):
        df = spark.createDataFrame([(str(i % 2), float(v)) for i, v in enumerate(values)], "k string, v double")
        got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", [0.0, 0.01, 0.5, 0.999], list("abcd"), accuracy=200, limit=300).collect()}
        for k in "01":
            assert np.allclose([got[k][c] for c in "abcd"], np.quantile(values[int(k)::2], [0.0, 0.01, 0.5, 0.999]))
    assert len(passes) >= 2 and passes[0] < 300  # a bracket of 1,000 rows before


def test_correlations_of_many_series_by_tiles(spark, monkeypatch):
    from tidelens.operators import market

    rng = np.random.default_rng(4)
    data = rng.normal(size=(40, 70)).cumsum(axis=0) + 1e6
    data[:, 5] = 7.25  # constant
    hole = rng.random((40, 70)) < 0.2
    hole[11:, 9] = True  # under ten points in common with many
    rows = [(f"s{j:03d}", i, None if hole[i, j] else float(data[i, j])) for i in range(40) for j in range(70)]
    df = spark.createDataFrame(rows, "name string, day long, x double")
    monkeypatch.setattr(market, "TILE", 16)
    monkeypatch.setattr(market, "CHUNK", 9)
    got = {(r["left"], r["right"]): (r["points"], r["correlation"]) for r in market.correlation_pairs(df, "name", "day", "x").collect()}
    for a in range(70):
        for b in range(a + 1, 70):
            both = ~hole[:, a] & ~hole[:, b]
            key = (f"s{a:03d}", f"s{b:03d}")
            if both.sum() < 10:
                assert key not in got
                continue
            x, y = data[both, a], data[both, b]
            want = 0.0 if 5 in (a, b) else np.corrcoef(x, y)[0, 1]
            assert got.pop(key) == (both.sum(), pytest.approx(want, abs=1e-9))
    assert not got


def test_two_thousand_series_have_the_plan_of_ten(spark):
    from tidelens.operators.market import correlation_pairs

    def plan(n):
        df = spark.range(n * 12).select((F.col("id") % n).alias("s"), F.floor(F.col("id") / n).alias("t"), F.rand(7).alias("v"))
        out = correlation_pairs(df, "s", "t", "v")
        return out, out._jdf.queryExecution().optimizedPlan().toString().count("\n")

    small, large = plan(10), plan(2000)
    assert small[1] == large[1] and large[0].count() == 2000 * 1999 // 2


def test_weighted_average_keeps_its_digits_far_into_a_series(spark):
    from tidelens.operators.registry import many

    rng = np.random.default_rng(8)
    close = 100 + rng.normal(size=60).cumsum()
    rows = [("a", hours(i), float(x), float(x), float(x), float(x), 1.0, 10**9 + i + 1) for i, x in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, _rn long")
    got = {r["ts"]: r["w"] for r in many(bars, {"w": ("wma", 14)}, keep=("symbol", "ts")).collect()}
    weights = np.arange(1, 15) / 105.0
    for i in range(14, 60):
        assert abs(got[hours(i)] - close[i - 13:i + 1] @ weights) < 1e-9


def test_principal_components_of_broken_vectors_and_empty_tables(spark):
    from tidelens.operators.prep import principal_components

    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 4)) * [4, 2, 1, 0.5])] + [(90, None), (91, [1.0, None, 0.0, 0.0]), (92, [1.0]), (93, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {r["vec_id"]: [r[f"pca_{i}"] for i in range(1, 5)] for r in principal_components(df, "v", k=9).collect()}
    assert all(got[i] == [None] * 4 for i in (90, 91, 92, 93)) and len(got) == 34
    x = np.array([v for i, v in rows[:30]])
    scores = np.array([got[i] for i in range(30)])
    assert np.allclose(np.linalg.norm(scores, axis=1), np.linalg.norm(x, axis=1))  # a rotation
    assert np.allclose(np.var(scores, axis=0), np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    assert principal_components(df, "v", share=0.5).columns == ["vec_id", "pca_1"]
    assert principal_components(df.limit(0), "v", share=0.5).count() == 0

"""Hand-made fixtures with expected values computed by hand or by a plain loop."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import T0, assert_rows, hours
from tidelens.functions import formula
from tidelens.operators import evaluation as E
from tidelens.operators import portfolio as P
from tidelens.operators import prep, quality, rules, social, vaults
from tidelens.operators.series import number_rows
from tidelens.sources import logs, sinks
from tidelens.sources.bars import numbered, resample
from tidelens.streaming import jobs


# --- gaps, duplicates, imputation ------------------------------------------------------


@pytest.fixture(scope="module")
def gap_bars(spark):
    rows = [("a", hours(h), c) for h, c in [(0, 1.0), (1, None), (2, 3.0), (3, None), (4, None), (9, 9.0), (10, None)]]
    return numbered(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"))


def test_gap_is_found(gap_bars):
    got = quality.gaps(gap_bars).collect()
    assert [(r["ts"], r["step"]) for r in got] == [(hours(9), 5 * 3600)]


def test_fill_forward_backward_and_linear(gap_bars):
    both = [r["close"] for r in quality.fill_both(gap_bars, ["close"]).orderBy("ts").collect()]
    assert both == [1, 1, 3, 3, 3, 9, 9]
    line = [r["close"] for r in quality.fill_linear(gap_bars, ["close"]).orderBy("ts").collect()]
    assert line == [1, 2, 3, 5, 7, 9, 9]


def test_duplicate_times(spark):
    df = spark.createDataFrame([("a", hours(0)), ("a", hours(0)), ("a", hours(1)), ("b", hours(0))], "symbol string, ts timestamp")
    assert {r["symbol"]: r["duplicates"] for r in quality.duplicate_times(df).collect()} == {"a": 1, "b": 0}


def test_missing_columns_are_named(gap_bars):
    with pytest.raises(ValueError, match="volume"):
        quality.require_columns(gap_bars, ["close", "volume"])


def test_knn_uses_nearest_donors(spark):
    rows = [(i, float(i), float(10 * i)) for i in range(20)] + [(99, 7.1, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r["id"]: r["b"] for r in quality.fill_knn(df, ["a", "b"], "id", k=3).collect()}
    assert got[99] == 70.0 and got[5] == 50.0 and len(got) == 21


def test_knn_is_exact_over_all_cells_and_patterns(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    names, n, k = ["a", "b", "c", "d"], 900, 4
    data = np.column_stack([rng.integers(0, 40, n), rng.normal(0, 1000, n).round(1), rng.integers(0, 5, n), rng.exponential(3, n).round(1)]).astype(float)
    hole = rng.random((n, 4)) < 0.25
    hole[0] = True
    keys = [None if i in (3, 4) else i if i % 50 else 7 for i in range(n)]  # null and repeated ones
    rows = [(keys[i], *[None if h else float(v) for v, h in zip(data[i], hole[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = quality.fill_knn(df, names, "id", k=k, cell=10).collect()
    whole = np.flatnonzero(~hole.any(axis=1))
    near, last = {}, float("inf")
    for i in np.flatnonzero(hole.any(axis=1) & ~hole.all(axis=1)):
        s = ~hole[i]
        near.setdefault(keys[i], []).extend((np.sqrt(((data[j, s] - data[i, s]) ** 2).sum()), last if keys[j] is None else keys[j], *data[j]) for j in whole)
    means = data[whole].mean(axis=0)
    want = []
    for i in range(n):
        best = sorted(near[keys[i]])[:k] if keys[i] is not None and keys[i] in near and hole[i].any() else []
        fill = np.mean([b[2:] for b in best], axis=0) if best else means
        want.append((keys[i], *np.where(hole[i], fill, data[i]).tolist()))
    order = lambda r: (r[0] is None, r[0] or 0, *[round(v, 6) for v in r[1:]])
    assert_rows(sorted(map(tuple, got), key=order), sorted(want, key=order))


def test_knn_opens_few_cells_when_one_column_says_little():
    import numpy as np

    rng = np.random.default_rng(6)
    points = np.column_stack([rng.random(50_000), rng.random(50_000) * 1000])
    parts = 20
    tree, asked = quality._cut(points, parts), points[:500]
    opened = sum(len(c) for _, c in quality._cells(tree, asked - 5.0, asked + 5.0, parts, np.arange(500)))
    assert 500 <= opened < 500 * 3 * parts  # all of the 400 cells by the first column alone
    place = np.concatenate([np.stack(x) for x in quality._cells(tree, points, points, parts, np.arange(50_000))], axis=1)
    size = np.bincount(place[1])
    assert len(place[0]) == 50_000 and len(size) == 400 and size.max() < 200


def test_knn_cells_are_as_long_as_wide():
    import numpy as np

    rng = np.random.default_rng(6)
    points = np.column_stack([rng.integers(0, 100, 50_000), rng.random(50_000) * 100_000]).astype(float)
    parts = quality._shape(points, 400)
    assert parts[0] == 1 and 300 < parts[1] <= 400
    tree, asked = quality._cut(points, parts), points[:500]
    opened = sum(len(c) for _, c in quality._cells(tree, asked - 5.0, asked + 5.0, parts, np.arange(500)))
    assert 500 <= opened < 600  # with 20 x 20 cells three or four for each row
    one = np.zeros((10, 2))
    assert quality._shape(one, 9) == (3, 3) and quality._shape(one[:0], 1) == (1, 1)


def test_knn_deals_crowded_cells_and_sends_little(spark, monkeypatch):
    import numpy as np

    for name, small in (("ASKED", 20), ("CHUNK", 640), ("HELD", 100)):
        monkeypatch.setattr(quality, name, small)
    rng = np.random.default_rng(8)
    n, k = 1500, 3
    data = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 2000, n), rng.integers(0, 4, n)]).astype(float)
    hole = np.column_stack([rng.random(n) < 0.3, rng.random(n) < 0.3, np.zeros(n, bool)])
    rows = [(i, *[None if h else float(v) for v, h in zip(data[i], hole[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    found = quality.fill_knn(df, ["a", "b", "c"], "id", k=k, cell=40)
    whole, want = np.flatnonzero(~hole.any(axis=1)), []
    for i in range(n):
        s = ~hole[i]
        near = sorted((np.sqrt(((data[j, s] - data[i, s]) ** 2).sum()), j) for j in whole)[:k]
        want.append((i, *np.where(hole[i], np.mean([data[j] for _, j in near], axis=0), data[i]).round(6).tolist()))
    assert sorted((r["id"], *[round(v, 6) for v in (r["a"], r["b"], r["c"])]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0  # filled rows are not joined with their nearest again


def test_forest_flags_the_far_rows(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(400)] + [(1000 + i, 500.0 + i, -400.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = quality.outliers_forest(df, ["a", "b"], "id", share=0.01).collect()
    assert {r["id"] for r in got if r["outlier"]} >= {1000, 1001, 1002, 1003}
    assert max(r["a"] for r in got) < 400 and len(got) == 404


def test_scaler_roundtrip_and_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 8.0, 5.0)], "id int, a double, k double")
    st = quality.fit_scaler(df, ["a", "k"], "standard")
    z = quality.scale(df, st, ["a", "k"]).orderBy("id").collect()
    assert abs(sum(r["a"] for r in z)) < 1e-12 and [r["k"] for r in z] == [5.0] * 3
    assert_rows(quality.unscale(quality.scale(df, st, ["a"]), st, ["a"]).orderBy("id").select("a").collect(), [(1.0,), (3.0,), (8.0,)])


# --- forecasts ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def preds(spark):
    prev = [99, 100, 102, 101, 105, 107, 106, 109, 108, 110]
    true = [100, 102, 101, 105, 107, 106, 109, 108, 110, 112]
    pred = [101, 101, 103, 104, 106, 108, 108, 110, 109, 113]
    rows = [("m", hours(i), i + 1, float(t), float(p), float(v), 2.0, 1.0) for i, (t, p, v) in enumerate(zip(true, pred, prev))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, _rn long, y_true double, y_pred double, prev double, y_std double, weight double")


def test_regression_and_direction(preds):
    r = E.regression(preds).first()
    err = np.array([-1, 1, -2, 1, 1, -2, 1, -2, 1, -1])
    assert math.isclose(r["rmse"], math.sqrt((err**2).mean())) and r["mae"] == 1.3 and r["median_ae"] == 1.0 and r["max_ae"] == 2.0
    d = E.directional(preds).first()
    assert (d["tp"], d["fp"], d["fn"], d["tn"]) == (7, 3, 0, 0) and d["recall"] == 1.0 and d["precision"] == 0.7


def test_mase_and_streaks(preds):
    t = E.time_series(preds).first()
    y = np.array([100, 102, 101, 105, 107, 106, 109, 108, 110, 112.0])
    assert math.isclose(t["mase"], 1.3 / np.abs(np.diff(y)).mean())
    rows = preds.withColumn("v", F.when(F.col("_rn").isin(1, 2, 5, 6, 7), 1.0).when(F.col("_rn") == 4, 0.0).otherwise(-1.0))
    s = E.streaks(rows, "v").first()
    assert (s["max_consecutive_wins"], s["max_consecutive_losses"]) == (3, 3)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("k", 0.1, 0), ("k", 0.4, 0), ("k", 0.4, 1), ("k", 0.8, 1)], "k string, s double, y int")
    assert E.roc_auc(df, "k", "s", "y").first()["auc"] == 0.875


# --- votes ------------------------------------------------------------------------------


def test_votes_tiny(spark):
    rows = []

    def vote(p, choice, power, n=1, at=0):
        for _ in range(n):
            rows.append((len(rows), p, len(rows), hours(at), choice, power, 1000))

    vote("quorum_missed", "yes", 10)
    vote("veto", "yes", 900), vote("veto", "veto", 1)
    vote("exact", "yes", 100), vote("exact", "no", 100)
    vote("lost", "yes", 100), vote("lost", "no", 102)
    rows.append((len(rows), "lost", rows[-2][2], hours(1), "yes", 999, 1000))  # the second vote of a voter does not count
    df = spark.createDataFrame(rows, "vote_id long, proposal string, voter long, ts timestamp, choice string, power long, supply long")
    got = {r["proposal"]: (r["quorum_achieved"], r["threshold_achieved"]) for r in vaults.tally(df).collect()}
    assert got == {"quorum_missed": (False, False), "veto": (False, False), "exact": (True, True), "lost": (True, False)}


def test_running_balance_is_floored(spark):
    rows = [(1, "v", "deposit", 5.0), (2, "v", "withdrawal", 8.0), (3, "v", "deposit", 3.0), (4, "v", "fee", 9.0), (5, "v", "withdrawal", 1.0)]
    df = spark.createDataFrame([(t, v, k, a, hours(t)) for t, v, k, a in rows], "tx long, vault string, kind string, amount double, ts timestamp")
    assert [r["balance"] for r in vaults.running_balance(df).orderBy("tx").collect()] == [5, 0, 3, 3, 2]


# --- posts --------------------------------------------------------------------------------


def test_posts_tiny(spark):
    rows = []
    for i in range(12):
        tags = ["x", "y"] if i == 0 else ["x"] if i < 11 else ["y"]
        rows.append((i, "src", f"post {i} scam" if i < 2 else f"post {i}", f"u{i % 4}", 500 if i == 3 else 10000, hours(i), -0.6 if i >= 7 else 0.5, 0.5, {"likes": i}, tags))
    schema = "post_id long, platform string, content string, author string, followers long, ts timestamp, sentiment double, confidence double, engagement map<string,bigint>, protocols array<string>"
    df = spark.createDataFrame(rows, schema)
    m = {r["protocol"]: r for r in social.protocol_metrics(df).collect()}
    x, y = m["x"], m["y"]
    assert x["mention_count"] == 11 and y["mention_count"] == 2 and x["unique_authors"] == 4
    assert math.isclose(x["sentiment_score"], (7 * 0.5 - 4 * 0.6) / 11) and x["total_engagement"] == sum(range(11))
    assert math.isclose(x["influencer_sentiment"], (6 * 0.5 - 4 * 0.6) / 10)
    assert set(x["risk_signals"]) == {"high_negative_sentiment", "fud_spreading", "sentiment_deterioration"}
    assert "sentiment_deterioration" not in y["risk_signals"]


def test_themes_use_pairs_and_stop_words(spark):
    df = spark.createDataFrame([("The vault and the yield farm", ["x"]), ("yield farm", ["x"])], "content string, protocols array<string>")
    got = {r["term"]: r["n"] for r in social.themes(df).collect()}
    assert got["yield farm"] == 2 and got["vault yield"] == 1 and "the" not in got


@pytest.mark.parametrize("few", [100_000, 0])
def test_themes_shuffle_only_pairs_of_frequent_words_and_rank_as_plain_counts(spark, monkeypatch, few):
    monkeypatch.setattr(social, "FEW_WORDS", few)
    rng = random.Random(8)
    texts = [(" ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(60))), rng.choice([["x"], ["y"], ["x", "y"], [None], None])) for _ in range(150)]
    texts += [(None, ["x"]), ("", ["y"]), ("the", ["y"]), ("alone", ["z"]), ("same same same", ["z"])]
    want = {}
    for content, tags in texts:
        w = [x for x in (content or "").split() if x not in social.STOP_WORDS]
        for p in tags or []:
            for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
                want.setdefault(p, {}).setdefault(t, 0)
                want[p][t] += 1
    want = {(p, t): (n, i + 1) for p, c in want.items() for i, (t, n) in enumerate(sorted(c.items(), key=lambda r: (-r[1], r[0]))[:12])}
    counted, frame = [], type(spark.range(0))
    group = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda df, *c: (counted.append(df) if c == ("protocols", "a", "b") else None, group(df, *c))[1])
    df = spark.createDataFrame(texts, "content string, protocols array<string>")
    got = {(r["protocol"], r["term"]): (r["n"], r["rank"]) for r in social.themes(df, 12, 12, 0.0).collect()}
    assert got == want
    words = {r[0] for r in counted[0].select("a").union(counted[0].select("b")).distinct().collect()}
    assert 0 < len(words) <= 3 * 12 + 12  # was all of them


# --- logs -----------------------------------------------------------------------------------


def _log(sig, err, body, tag="SignalSubmitted"):
    return (sig, err, ["Program log: hi", f"Program log: {tag} {body}"])


def test_logs_tiny(spark):
    ok = json.dumps({"model_id": 1, "signal_id": 7, "timestamp": 5, "verified": True})
    rows = [_log("a", None, ok), _log("a", None, ok), _log("b", "Err", ok), _log("c", None, '{"model_id": oops'), _log("d", None, ok, "SignalExecuted")]
    df = spark.createDataFrame(rows, "signature string, err string, logs array<string>")
    got = logs.once(logs.events(df, "SignalSubmitted", logs.SIGNAL_SUBMITTED)).filter("signal_id IS NOT NULL").collect()
    assert [(r["signature"], r["position"], r["model_id"], r["signal_id"]) for r in got] == [("a", 1, 1, 7)]


def test_append_only_new_keys(spark):
    old = spark.createDataFrame([(1,)], "k int")
    new = spark.createDataFrame([(1, 5), (2, 9), (2, 3)], "k int, v int")
    assert [tuple(r) for r in sinks.append_new(new, old, ["k"], ["v"]).collect()] == [(2, 3)]


# --- portfolio, allocations ------------------------------------------------------------


def test_var_is_positional_with_ties(spark):
    ret = [0.0] * 10 + [-0.1] * 10 + [float(i) / 100 for i in range(1, 41)]
    df = spark.createDataFrame([("p", r) for r in ret], "symbol string, ret double")
    r = P.value_at_risk(df).first()
    assert r["var_95"] == 0.1 and r["var_99"] == 0.1 and math.isclose(r["expected_shortfall"], 0.1)


def test_cumulative_growth_handles_losses_beyond_total(spark):
    df = spark.createDataFrame([("p", hours(i), r) for i, r in enumerate([0.5, -3.0, 0.5, -1.0, 4.0])], "symbol string, ts timestamp, ret double")
    got = [r["growth"] for r in P.cumulative_growth(number_rows(df), "ret").orderBy("ts").collect()]
    assert np.allclose(got, np.cumprod(1 + np.array([0.5, -3.0, 0.5, -1.0, 4.0])))


def test_limits_keep_the_sum(spark):
    w = spark.createDataFrame([("p", a, v) for a, v in [("a", 0.7), ("b", 0.2), ("c", 0.1)]], "portfolio string, asset string, weight double")
    got = {r["asset"]: r["weight"] for r in P.limit_allocations(w, F.lit(1.0)).collect()}
    assert math.isclose(sum(got.values()), 1.0) and got == pytest.approx({"a": 0.2, "b": 0.45, "c": 0.35})


def test_pair_ratio_equals_all_pairs(spark):
    prices = [3.0, 5.0, 5.0, 9.0]
    df = spark.createDataFrame([(T0, str(i), p) for i, p in enumerate(prices)], "ts timestamp, asset string, price double")
    want = np.mean([min(a, b) / max(a, b) for i, a in enumerate(prices) for b in prices[i + 1:]])
    assert math.isclose(P.pair_ratio(df).first()["pair_ratio"], want)


# --- rules, formulas, preparation ----------------------------------------------------------------


def test_rules_report_the_broken_ones(spark):
    df = spark.createDataFrame([("p", "conservative", "curve", 40.0), ("p", "conservative", "aave", 60.0)], "portfolio string, tolerance string, protocol string, percentage double")
    r = rules.allocation_limits(df).first()
    assert r["over_single"] == ["aave", "curve"] and r["over_volatile"] and not r["valid"]
    assert rules.allocation_sum(df).first()["valid"]


def test_formulas_are_checked():
    cols = ["a", "b"]
    formula.expression("sqrt(a) + b * 2", cols)
    for bad in ("secret + 1", "java_method('x', 'y')", "a; drop", "reflect(a)"):
        with pytest.raises(ValueError):
            formula.expression(bad, cols)


def test_prepare_scales_on_train_only_and_never_crosses_splits(spark):
    rows = [("a", hours(i), float(i), float(i % 7)) for i in range(200)]
    num = numbered(spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double"))
    out = prep.prepare(num, ["close", "volume"], "close", lookback=5, purge=5).collect()
    by = {s: [r for r in out if r["split"] == s] for s in ("train", "val", "test")}
    assert all(by.values()) and max(r["ts"] for r in by["train"]) < min(r["ts"] for r in by["val"])
    assert len(by["train"]) == 135 - 5 and len(by["test"]) == 30 - 5
    first = [r["x"][0][0] for r in by["train"]]
    assert first == sorted(first) and abs(first[0] + first[-1]) < 1.0  # centred on train
    assert max(v for r in by["test"] for x in r["x"] for v in x[:1]) < 2.0  # clipped at the train quantile


def test_augmentation_is_repeatable_and_keeps_shape(spark):
    rows = [("a", hours(i), float(i), 1.0) for i in range(60)]
    num = numbered(spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double"))
    seqs = prep.sequences(num, ["close", "volume"], "close", 16, 1, 2)
    a, b = ([(r["_rn"], r["method"], r["x"]) for r in prep.augment(seqs).orderBy("_rn", "method").collect()] for _ in range(2))
    assert a == b and len(a) > seqs.count()
    assert all(len(x) == 16 and all(len(v) == 2 for v in x) for _, _, x in a)


def test_resample_weeks_and_months(spark):
    rows = [("a", T0 + dt.timedelta(days=i), 1.0 * i, i + 2.0, i - 1.0, i + 1.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    m = resample(df, "1mo").orderBy("ts").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in m] == [(0.0, 31.0, 31.0), (31.0, 40.0, 9.0)]
    assert resample(df, "1w").filter("volume > 7").count() == 0


# --- streams ---------------------------------------------------------------------------------


def test_late_posts_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "post_id long, platform string, ts timestamp"
    for i, rows in enumerate([[(1, "s", hours(0)), (1, "s", hours(0)), (2, "s", hours(60))], [(6, "s", hours(61))], [(3, "s", hours(1)), (4, "s", hours(59)), (5, "s", hours(62))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    base, _ = jobs.run(jobs.ingest_posts(src), "late")
    got = sorted(r["post_id"] for r in jobs.results(spark, base, src.schema).collect())
    assert got == [1, 2, 4, 5, 6]  # the watermark of one batch filters late rows from the batch after the next


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:4] == ["symbol", "ts", "close", "volume"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

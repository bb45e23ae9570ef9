"""Hand-made bars, bounds, and block-size independence of every registered indicator."""

import pytest
from pyspark.sql import functions as F

from helpers import bars, same, walk
from tidelens.operators import registry
from tidelens.operators import stages
from tidelens.sources.bars import numbered

TINY = [
    (10, 11, 9, 10, 5), (10, 11, 9, 10, 5), (10, 11, 9, 10, 0), (10, 10, 10, 10, 5), (10, 12, 10, 12, 5), (12, 13, 11, 13, 5),
    (13, 14, 12, 14, 5), (14, 14, 12, 12, 5), (12, 13, 10, 11, 5), (11, 12, 10, 11, 5), (11, 15, 11, 15, 5), (15, 16, 14, 16, 5),
]


@pytest.fixture(scope="module")
def tiny(spark):
    return numbered(bars(spark, {"up": TINY, "flat": [(5, 5, 5, 5, 1)] * 12}))


def column(df, symbol, name):
    return [r[name] for r in df.filter(F.col("symbol") == symbol).orderBy("ts").collect()]


def test_rsi_limits(tiny):
    df = registry.indicator_frame(tiny, "rsi", 3)
    up = column(df, "up", "rsi")
    assert up[:3] == [None] * 3
    assert up[3] is None  # no move at all
    assert up[4] == 100.0 and up[5] == 100.0 and up[6] == 100.0
    assert abs(up[7] - 50.0) < 1e-9  # gains 1+1, loss 2
    assert column(df, "flat", "rsi") == [None] * 12


def test_sma_and_frames(tiny):
    sma = column(registry.indicator_frame(tiny, "sma", 4), "up", "sma")
    assert sma[:3] == [None] * 3 and sma[3] == 10.0 and sma[6] == 12.25


def test_cmf_with_zero_range(tiny):
    cmf = column(registry.indicator_frame(tiny, "cmf", 4), "flat", "cmf")
    assert cmf[3] == 0.0


def test_doji_and_hammer_flags(tiny):
    assert column(registry.indicator_frame(tiny, "doji", 1), "up", "doji")[:4] == [1, 1, 1, 0]


def test_ema_starts_at_first_close(tiny):
    ema = column(registry.indicator_frame(tiny, "ema", 3), "up", "ema")
    y = 10.0
    for got, row in zip(ema, TINY):
        y = y if row is TINY[0] else 0.5 * row[3] + 0.5 * y
        assert abs(got - y) < 1e-12


def test_bands_are_ordered_and_bounded(spark):
    b = numbered(bars(spark, {"w": walk(150)}))
    df = registry.many(b, {"bb": ("bollinger", 20), "rsi": ("rsi", 14), "st": ("stoch", 14), "w": ("williams", 14)})
    for r in df.dropna().collect():
        assert r["bb_lower"] <= r["bb_middle"] <= r["bb_upper"]
        assert 0 <= r["rsi"] <= 100 and -1e-9 <= r["st_k"] <= 100 + 1e-9 and -100 - 1e-9 <= r["w"] <= 1e-9


ALL = [*registry.REGISTRY, *registry.CONFIG_SET]


@pytest.mark.parametrize("part", range(4))
def test_every_indicator_is_block_independent(spark, monkeypatch, part):
    from tidelens.operators import series

    names = ALL[part::4]
    b = bars(spark, {"w": walk(140), "v": walk(90, 5)}).withColumn("ref", F.col("close") * 0.5 + F.col("volume")).withColumn("bucket", F.lit(300.0))
    b = numbered(b)
    b = spark.createDataFrame(b.collect(), b.schema)
    wanted = {n: (n, 0.02 if n in ("parabolic_sar", "psar") else 9) for n in names}
    whole = registry.many(b, wanted).orderBy("symbol", "ts").collect()
    monkeypatch.setattr(series, "SCAN_ROWS", 16)
    monkeypatch.setattr(series, "SCAN_FAN", 3)
    monkeypatch.setattr(series, "SCAN_TOP", 2)
    monkeypatch.setattr(series, "BLOCK_ROWS", 32)
    cut = registry.many(b, wanted, rows=32).orderBy("symbol", "ts").collect()
    assert len(whole) == len(cut) == 230
    for x, y in zip(whole, cut):
        for n in x.__fields__:
            assert same(x[n], y[n], 1e-7), (n, x["symbol"], x["ts"], x[n], y[n])


def test_registry_covers_all_names_and_periods():
    assert len(registry.REGISTRY) == 52
    assert registry.default_periods("sma") == [14, 50, 200]
    assert registry.default_periods("rsi") == [14] and registry.default_periods("parabolic_sar") == [0.02]


def test_feature_names_match_columns(spark, tiny):
    names = registry.feature_names(["sma", "macd", "doji"], {"sma": [3, 5]})
    assert names == ["sma_3", "sma_5", "macd_macd", "macd_signal", "macd_histogram", "doji"]
    df = registry.calculate_all(tiny, ["sma", "macd", "doji"], {"sma": [3, 5]})
    assert [c for c in df.columns if c not in ("symbol", "ts", "open", "high", "low", "close", "volume")] == names
    assert column(df, "up", "sma_3")[:2] == [0.0, 0.0]


def test_user_indicator(spark, tiny):
    def midpoint(t, n):
        yield stages.Roll([{t("y"): (F.col("high") + F.col("low")) / 2}], 0)
        return {"": t["y"]}

    registry.register("midpoint", midpoint, [1])
    try:
        assert column(registry.calculate_all(tiny, ["midpoint"]), "up", "midpoint")[0] == 10.0
    finally:
        del registry.REGISTRY["midpoint"], registry.DEFAULT_PERIODS["midpoint"]

import datetime as dt
import math

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def bars(spark, series):
    """series: symbol -> list of (open, high, low, close, volume)."""
    rows = [(s, hours(i), *map(float, r)) for s, rs in series.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def walk(n, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    out, prev = [], 100.0
    for c in close:
        out.append((prev, max(prev, c) + rng.uniform(0, 1), min(prev, c) - rng.uniform(0, 1), c, float(rng.integers(1, 100))))
        prev = c
    return out


def same(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=tol)
    return a == b


def assert_rows(got, want, tol=1e-9):
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert all(same(x, y, tol) for x, y in zip(g, w)), (g, w)

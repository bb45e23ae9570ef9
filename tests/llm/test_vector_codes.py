"""Vector codes against plain loops over all entries."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings, strategies as st

from tidelens.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def plain(rows, rounds=4):
    """vec_id -> (code, error) and the digest, by exhaustive search over Python integers."""
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows)
    width = max(-(-max(len(v) for _, v in kept) // 4), 1)
    parts = [[(v + [0] * 4 * width)[p * width:(p + 1) * width] for _, v in kept] for p in range(4)]
    books = [[list(v) for v in part[:256]] for part in parts]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            own = {}
            for v in parts[p]:
                own.setdefault(near(v, books[p])[1], []).append(v)
            for k, vs in own.items():
                books[p][k] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [[near(v, books[p]) for v in parts[p]] for p in range(4)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return ({i: ("".join(f"{found[p][n][1]:02x}" for p in range(4)), sum(found[p][n][0] for p in range(4))) for n, (i, _) in enumerate(kept)},
            hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_masks_find_the_first_of_the_nearest(entries, width, points, seed):
    rng = np.random.default_rng(seed)
    spread = int(rng.choice([2, 50, 10_000]))
    book, x = rng.integers(-spread, spread, (entries, width)), rng.integers(-2 * spread, 2 * spread, (points, width))
    best, distance = V.Masks(book).nearest(x)
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert best.tolist() == d.argmin(axis=1).tolist() and distance.tolist() == d.min(axis=1).tolist()
    r = rng.integers(0, 2 * spread, points)
    point, entry = V.Masks(book).within(x, r)
    assert list(zip(point, entry)) == list(zip(*np.nonzero((abs(x[:, None] - book[None]) <= r[:, None, None]).all(axis=2))))


def test_masks_leave_entries_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (256, 16))
    x = centres[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 16))
    m = V.Masks(centres)
    point, _ = m.within(x, m.radius(x))
    assert len(point) < 2000 * 256 / 4  # of all pairs


def _check(spark, rows):
    got = {r["vec_id"]: r for r in V.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    want, digest = plain([(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)])
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == want
    total = {}
    for i, _, label, *_ in rows:
        if i in want:
            total[label] = total.get(label, 0) + want[i][1]
    assert all(r["codebooks_sha256"] == digest for r in got.values())
    assert all(r["label_error"] == total[label] for i, _, label, *_ in rows if (r := got.get(i)))


def test_many_vectors_with_ties_and_broken_ones(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.integers(-3, 4, 8) / 8).tolist(), [None, 1, 1, 2][i % 4], 0, "x") for i in rng.permutation(700)]
    rows += [(1000, None, 1, 0, "x"), (1001, [0.1] * 7 + [None], 1, 0, "x"), (1002, [float("nan")] * 8, 1, 0, "x"), (1003, [float("inf")] + [0.0] * 7, 2, 0, "x"),
             (1004, [0.0] * 8, 2, 0, "x"), (1005, [1.5, -0.0004], None, 0, "x"), (1006, [], 3, 0, "x")]
    _check(spark, rows)


def test_few_vectors_odd_lengths_and_empty_tables(spark):
    _check(spark, [(5, [0.5, -0.25, 0.125, 1.0, 0.3], 1, 0, "x"), (2, [0.5, -0.25, 0.125, 1.0, 0.3], 1, 0, "x"), (9, [1.0], None, 0, "x")])
    assert V.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.compress(spark.createDataFrame([(1, None, 1, 0, "x")], SCHEMA)).count() == 0
    far = V.compress(spark.createDataFrame([(1, [3e38, -3e38, 1.0, 0.0], 1, 0, "x"), (None, [0.0] * 4, 1, 0, "x"), (1, [0.0] * 4, 1, 0, "x")], SCHEMA)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in far) == [(False, 1), (False, 1), (True, None)] and all(r["error"] == 0 for r in far)

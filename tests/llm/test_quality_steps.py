"""The classifier's updates and scores against plain per-coordinate steps over dictionaries."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelens.llm import quality, text as T

BITS, ALPHA, BETA, L1, L2 = 12, 0.3, 1.0, 0.02, 0.1


def vector(text):
    """bucket -> share of the n-grams of its kind, summed over the kinds, and the bias."""
    raw, off = T.buffers(pa.array([text], pa.string()))
    x = {1 << BITS: 1.0}
    for bucket, _ in quality.features(raw, off, BITS):
        for b in bucket.tolist():
            x[b] = x.get(b, 0.0) + 1 / len(bucket)
    return x


def weight(z, n, i):
    if i != 1 << BITS and abs(z.get(i, 0.0)) <= L1:
        return 0.0
    return -(z.get(i, 0.0) - math.copysign(L1, z.get(i, 0.0)) * (z.get(i, 0.0) != 0)) / ((BETA + math.sqrt(n.get(i, 0.0))) / ALPHA + L2)


def learn(steps):
    z, n = {}, {}
    for text, target in steps:
        x = vector(text)
        w = {i: weight(z, n, i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
        for i in x:
            g = (p - target) * x[i]
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / ALPHA
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(z, n, i))}


@pytest.mark.parametrize("passes", [1, 3])
def test_weights_and_scores_equal_plain_steps(spark, passes):
    texts = ["Good prose in many words, as it should be.", "BUY $$$ now!!! BUY $$$ now!!!", "", None, "one", "Another sentence of good prose; it is fine.", "x1 x1 x1 x1 zz9 zz9",
             "É wide chars — and more", "word " * 3000, "Mixed GOOD and $$$ words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i != 4 else None) for i in range(9)], "doc_id long, quality int")
    model = quality.fit(docs, labels, passes=passes, bits=BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2)
    order = spark.createDataFrame([(i, p) for i in range(9) if i != 4 for p in range(1, passes + 1)], "id long, pass int").withColumn("h", F.xxhash64("id", "pass")).orderBy("pass", "h", "id").collect()
    want = learn([(texts[r["id"]] or "", r["id"] % 2) for r in order])
    got = {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}
    if model.bias:
        got[1 << BITS] = model.bias
    assert set(got) == set(want) and all(got[i] == pytest.approx(w, rel=1e-6, abs=1e-9) for i, w in want.items())
    scores = {r["doc_id"]: r["s"] for r in quality.score_quality(docs, model, out="s").collect()}
    for i, t in enumerate(texts):
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-sum(want.get(b, 0.0) * v for b, v in vector(t or "").items()))), abs=1e-6)

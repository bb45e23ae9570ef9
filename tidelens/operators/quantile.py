"""Exact quantiles of unbounded groups by selection in passes.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a
sketch with a proven rank error brackets each wanted quantile. While a bracket may hold
more than ``LIMIT`` rows, another pass counts what lies below it and sketches what lies
inside, which narrows it some hundred times. Then rows outside are only counted
(map-side), and the rows inside are grouped by value and ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ACCURACY = 10_000
LIMIT = 100_000  # values of one bracket that are put in order in one task
FEW = 10_000  # groups whose brackets, a few hundred bytes each, are sent to all tasks: rows of few large groups are not dealt by group


def exact_quantiles(
    df: DataFrame, keys, value: str, probs: list[float], names: list[str], method: str = "linear", accuracy: int = ACCURACY,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per key with the requested quantiles.

    ``method='linear'`` interpolates at rank p*(n-1); ``'position'`` takes the value at
    rank floor(n*p), counted from zero. The sketch value at q has a true rank within
    n/accuracy of q*n, so [p - 4/accuracy, p + 4/accuracy] surely holds the wanted
    ranks once n is at least ``accuracy``; below that the whole (small) group is ranked.
    """
    keys = list(keys)
    ks = keys or ["_k"]
    x = df if keys else df.withColumn("_k", F.lit(0))
    x = x.select(*ks, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    margin = 4.0 / accuracy
    grid = sorted({max(0.0, p - margin) for p in probs} | {min(1.0, p + margin) for p in probs})
    st = x.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", grid, accuracy).alias("_e"))
    whole = F.col("_n") < accuracy
    cells = []
    for i, p in enumerate(probs):
        lo = F.when(whole, F.lit(float("-inf"))).otherwise(F.col("_e")[grid.index(max(0.0, p - margin))])
        hi = F.when(whole, F.lit(float("inf"))).otherwise(F.col("_e")[grid.index(min(1.0, p + margin))])
        cells.append(F.struct(F.lit(i).alias("_i"), lo.alias("_lo"), hi.alias("_hi")))
    st = cut_lineage(st.select(*ks, "_n", F.array(*cells).alias("_cells")))
    # the first sketch leaves at most a known share of the rows in a bracket
    most, groups = st.agg(F.max("_n"), F.count(F.lit(1))).first()
    near = F.broadcast if groups <= FEW else lambda rows: rows
    inside = (most or 0) * 10.0 / accuracy
    while inside > max(limit, accuracy):
        st, left = _narrowed(x, st, ks, probs, method, accuracy, near)
        inside = left if left < inside / 2 else 0  # what is left is a few values many times over
    borders = F.sort_array(F.flatten(F.transform("_cells", lambda c: F.array(c["_lo"], c["_hi"]))))
    st = st.select(*ks, "_n", "_cells", borders.alias("_b"))
    # one row for each value: its zone between the borders, and the value itself only inside a bracket
    inside = F.exists("_cells", lambda c: (F.col("_v") >= c["_lo"]) & (F.col("_v") <= c["_hi"]))
    zone = F.size(F.filter("_b", lambda b: b < F.col("_v")))
    counts = (
        x.join(near(st), ks).select(*ks, "_n", zone.alias("_z"), F.when(inside, F.col("_v")).alias("_v"))
        .groupBy(*ks, "_z", "_v").agg(F.count(F.lit(1)).alias("_m"), F.max("_n").alias("_n"))
    )
    run = Window.partitionBy(*ks).orderBy("_z", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_to", F.sum("_m").over(run))
    out, aggs = [], []
    missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    for i, (p, name) in enumerate(zip(probs, names)):
        h = _rank(p, method)

        def at(rank):
            return F.max(F.when((F.col("_to") - F.col("_m") <= rank) & (rank < F.col("_to")), F.col("_v")))

        aggs += [at(F.floor(h)).alias(f"_q{i}a"), at(F.ceil(h)).alias(f"_q{i}b"), F.max(h - F.floor(h)).alias(f"_q{i}w")]
        low, high = (F.coalesce(F.col(f"_q{i}{s}"), missed) for s in "ab")
        out.append((low + (high - low) * F.col(f"_q{i}w")).alias(name))
    return upto.groupBy(*ks).agg(*aggs).select(*keys, *out)


def _rank(p: float, method: str):
    """The wanted rank, counted from zero."""
    return (F.col("_n") - 1) * F.lit(p) if method == "linear" else F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1)


def _narrowed(x: DataFrame, st: DataFrame, ks: list[str], probs: list[float], method: str, accuracy: int, near) -> tuple[DataFrame, float]:
    """Brackets after another pass over the rows, and the most rows that lie strictly inside one.

    The rows below a bracket give the wanted ranks inside it; a sketch of the rows inside, at ``steps`` even shares, gives new ends
    one step to either side, ten times what the sketch may be off."""
    steps = max(accuracy // 10, 4)
    aggs = [F.first("_n").alias("_n"), F.first("_cells").alias("_cells")]
    for i in range(len(probs)):
        v, lo, hi = F.col("_v"), F.col("_cells")[i]["_lo"], F.col("_cells")[i]["_hi"]
        inside = (v >= lo) & (v <= hi)
        aggs += [F.count_if(v < lo).alias(f"_b{i}"), F.count_if(inside).alias(f"_m{i}"),
                 F.percentile_approx(F.when(inside, v), [k / steps for k in range(steps + 1)], accuracy).alias(f"_g{i}")]
    per = x.join(near(st), ks).groupBy(*ks).agg(*aggs)
    cells = []
    for i, p in enumerate(probs):
        share = lambda rank: (rank - F.col(f"_b{i}")) / F.col(f"_m{i}") * steps  # noqa: E731, B023
        a, z = F.floor(share(F.floor(_rank(p, method)))) - 1, F.ceil(share(F.ceil(_rank(p, method)) + 1)) + 1
        cell, grid = F.col("_cells")[i], F.col(f"_g{i}")
        cells.append(F.struct(F.lit(i).alias("_i"), F.when(a >= 0, F.get(grid, a.cast("int"))).otherwise(cell["_lo"]).alias("_lo"),
                              F.when(z <= steps, F.get(grid, z.cast("int"))).otherwise(cell["_hi"]).alias("_hi")))
    new = cut_lineage(per.select(*ks, "_n", F.array(*cells).alias("_cells")))
    strict = [F.count_if((F.col("_v") > F.col("_cells")[i]["_lo"]) & (F.col("_v") < F.col("_cells")[i]["_hi"])) for i in range(len(probs))]
    left = x.join(near(new), ks).groupBy(*ks).agg(F.greatest(*strict, F.lit(0)).alias("_l")).agg(F.max("_l")).first()[0]
    return new, float(left or 0)

"""Long ordered series without one task per series.

A window partitioned by symbol puts a whole series in one task, and one symbol may
hold a third of all rows. Here a series is numbered, then cut into blocks of
consecutive rows:

* ``number_rows``  exact row number per series of bars from counts per time bucket;
* ``blocks``       each block also receives the rows just before (after) it that its
                   rolling frames need, so every frame is complete inside one block;
* ``prefix``       running sum / max / min / last over the whole series: inside the
                   block, plus one carried value per block;
* ``affine_scan``  y[t] = a[t]*y[t-1] + b[t] over the whole series: affine maps
                   compose, so blocks are folded on their own and joined by a carry.

Nothing here is sized by the longest series: a task sees one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import c

BLOCK_ROWS = 4096
SCAN_ROWS = 512
SCAN_FAN = 2048
SCAN_TOP = 1024


def _default_bucket(order: str) -> Column:
    return F.date_trunc("month", F.col(order))


def number_rows(df: DataFrame, keys=("symbol",), order=("ts",), bucket: Column | None = None) -> DataFrame:
    """Add ``_rn`` = 1, 2, ... per key in the given order.

    Rows are ranked inside ``bucket`` (a coarse monotone function of the order column, month by default) and shifted by
    the count of all earlier buckets. For bars, of which a month holds so many at most; series of raw events are numbered
    by ``ordered.numbered``.
    """
    keys = list(keys)
    x = df.withColumn("_bk", bucket if bucket is not None else _default_bucket(order[0]))
    per = x.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_bk").orderBy(*order)
    return (
        x.join(per, [*keys, "_bk"])
        .withColumn("_rn", F.row_number().over(inside) + F.col("_off"))
        .drop("_bk", "_off")
    )


def blocks(df: DataFrame, history: int, ahead: int = 0, rows: int | None = None, spread: bool = False) -> DataFrame:
    """Assign ``_blk`` and copy edge rows into the neighbour block as ``_halo`` rows.

    ``spread`` fixes the number of partitions to the session's shuffle partitions: blocks
    are even, and wide frames cost far more than their bytes suggest, so merging small
    partitions by size would leave most cores idle.
    """
    rows = max(rows or BLOCK_ROWS, history, ahead, 1)
    b = F.floor((F.col("_rn") - 1) / rows)
    at = (F.col("_rn") - 1) % rows

    def copy(shift, halo):
        return F.struct((b + shift).cast("long").alias("_blk"), F.lit(halo).alias("_halo"))

    copies = [copy(0, False)]
    if history > 0:
        copies.append(F.when(at >= rows - history, copy(1, True)))
    if ahead > 0:
        copies.append(F.when((at < ahead) & (b > 0), copy(-1, True)))
    if len(copies) == 1:
        out = df.withColumns({"_blk": b.cast("long"), "_halo": F.lit(False)})
    else:
        out = df.select("*", F.inline(F.array_compact(F.array(*copies))))
    if spread:
        out = out.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "_blk")
    return out


WIDE_FRAME = 30


def unblock(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_blk", "_halo")


_PREFIX = {
    "sum": (F.sum, F.sum),
    "max": (F.max, F.max),
    "min": (F.min, F.min),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda x: F.last(x, ignorenulls=True)),
    "first": (lambda x: F.first(x, ignorenulls=True), lambda x: F.first(x, ignorenulls=True)),
}


def _join_prefix(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def prefix(df: DataFrame, specs: dict, keys=("symbol",), reverse: bool = False, rows: int | None = None) -> DataFrame:
    """Running aggregates over whole series. ``specs``: name -> (kind, column)."""
    rows, keys = rows or BLOCK_ROWS, list(keys)
    order = F.col("_rn").desc() if reverse else F.col("_rn").asc()
    border = F.col("_pb").desc() if reverse else F.col("_pb").asc()
    inside = Window.partitionBy(*keys, "_pb").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_pb", F.floor((F.col("_rn") - 1) / rows).cast("long"))
    x = x.withColumns({f"_l_{n}": _PREFIX[k][0](c(v)).over(inside) for n, (k, v) in specs.items()})
    edge = F.min_by if reverse else F.max_by
    tails = x.groupBy(*keys, "_pb").agg(*[edge(F.col(f"_l_{n}"), F.col("_rn")).alias(f"_t_{n}") for n in specs])
    before = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *keys, "_pb", *[_PREFIX[k][1](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in specs.items()]
    )
    out = x.join(carry, [*keys, "_pb"])
    out = out.withColumns({n: _join_prefix(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in specs.items()})
    return out.drop("_pb", *[f"_l_{n}" for n in specs], *[f"_c_{n}" for n in specs])


def _fold(items: Column, name: str) -> Column:
    """Composition of a list of affine maps as struct(a, b)."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def step(acc, x):
        a, b = x[f"a_{name}"], x[f"b_{name}"]
        return F.struct((a * acc["a"]).alias("a"), (a * acc["b"] + b).alias("b"))

    return F.aggregate(items, start, step)


def _entering(items: Column, start: Column, name: str) -> Column:
    """State entering each map of the list, given the state entering the first."""
    seed = F.struct(start.alias("y"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        y = x[f"a_{name}"] * acc["y"] + x[f"b_{name}"]
        return F.struct(y.alias("y"), F.concat(acc["out"], F.array(acc["y"])).alias("out"))

    return F.aggregate(items, seed, step, lambda acc: acc["out"])


def _through(maps: Column, name: str, start: Column | None = None) -> Column:
    """State after applying a list of folded maps to ``start`` (0, if not given)."""
    return F.aggregate(maps, F.lit(0.0) if start is None else start, lambda y, m: m[name]["a"] * y + m[name]["b"])


def _composed(maps: Column, name: str) -> Column:
    """One map for a list of folded maps."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, start, lambda acc, m: F.struct((m[name]["a"] * acc["a"]).alias("a"), (m[name]["a"] * acc["b"] + m[name]["b"]).alias("b")))


def _explode_states(df: DataFrame, keys: list, idx: str, names: list, starts: dict) -> DataFrame:
    arrays = [F.transform("_l", lambda x: x[idx]).alias(idx)]
    arrays += [_entering(F.col("_l"), starts[n], n).alias(f"_in_{n}") for n in names]
    return df.select(*keys, *arrays).select(*keys, F.inline(F.arrays_zip(idx, *[f"_in_{n}" for n in names])))


def affine_scan(df: DataFrame, specs: dict, keys=("symbol",), rows: int | None = None, fan: int = SCAN_FAN) -> DataFrame:
    """Add y[t] = a[t]*y[t-1] + b[t] (y before the first row is 0) per spec.

    ``specs``: name -> (a, b); ``a`` is a number (at least 0.3, or 1) or a positive
    column, ``b`` a column. Inside a block of ``rows`` the solution is
    P[t] * sum(b/P) with P the running product of ``a``; the block size keeps P far
    from underflow. Blocks are then folded ``fan`` at a time to the state that
    enters each of them.
    """
    memoryless = {n: b for n, (a, b) in specs.items() if not isinstance(a, Column) and a == 0.0}
    if memoryless:
        df = df.withColumns(memoryless)
        specs = {n: s for n, s in specs.items() if n not in memoryless}
        if not specs:
            return df
    rows, keys, names = rows or SCAN_ROWS, list(keys), list(specs)
    for n, (a, _) in specs.items():
        if not isinstance(a, Column) and not 0.3 <= a <= 1.0:
            raise ValueError(f"scan {n}: factor {a} outside [0.3, 1]")
    inside = Window.partitionBy(*keys, "_sb").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumns({
        "_sb": F.floor((F.col("_rn") - 1) / rows).cast("long"),
        "_at": ((F.col("_rn") - 1) % rows + 1).cast("double"),
    })
    scale = {}
    for n, (a, _) in specs.items():
        if isinstance(a, Column):
            scale[f"_p_{n}"] = F.exp(F.sum(F.log(a)).over(inside))
        else:
            scale[f"_p_{n}"] = F.lit(1.0) if a == 1.0 else F.pow(F.lit(float(a)), F.col("_at"))
    x = x.withColumns(scale)
    x = x.withColumns({
        f"_y_{n}": F.col(f"_p_{n}") * F.sum(F.coalesce(b, F.lit(0.0)) / F.col(f"_p_{n}")).over(inside)
        for n, (_, b) in specs.items()
    })
    ends = []
    for n in names:
        ends += [F.max_by(f"_p_{n}", "_rn").alias(f"a_{n}"), F.max_by(f"_y_{n}", "_rn").alias(f"b_{n}")]
    tails = x.groupBy(*keys, "_sb").agg(*ends)
    pair = [f"{s}_{n}" for n in names for s in "ab"]
    lists = (
        tails.groupBy(*keys, F.floor(F.col("_sb") / fan).cast("long").alias("_sup"))
        .agg(F.sort_array(F.collect_list(F.struct("_sb", *pair))).alias("_l"))  # at most ``fan`` blocks
    )
    # state entering each list: lists are folded ``SCAN_TOP`` at a time once more, so that what stands before a list is at most that
    # many lists of its own group, and one entry for each earlier group of a thousand million rows
    folds = F.struct(*[F.struct(_fold(F.col("_l"), n)["a"].alias("a"), _fold(F.col("_l"), n)["b"].alias("b")).alias(n) for n in names])
    lists = lists.withColumn("_f", folds).withColumn("_group", F.floor(F.col("_sup") / SCAN_TOP).cast("long"))
    groups = lists.groupBy(*keys, "_group").agg(F.transform(F.sort_array(F.collect_list(F.struct("_sup", "_f"))), lambda x: x["_f"]).alias("_m"))
    groups = groups.select(*keys, "_group", F.struct(*[_composed(F.col("_m"), n).alias(n) for n in names]).alias("_g"))
    groups = groups.withColumn("_past", F.collect_list("_g").over(Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
    groups = groups.select(*keys, "_group", *[_through(F.col("_past"), n).alias(f"_at_{n}") for n in names])
    earlier = Window.partitionBy(*keys, "_group").orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    lists = lists.withColumn("_before", F.collect_list("_f").over(earlier)).join(groups, [*keys, "_group"])
    lists = lists.withColumns({f"_top_{n}": _through(F.col("_before"), n, F.col(f"_at_{n}")) for n in names})
    carry = _explode_states(lists, keys, "_sb", names, {n: F.col(f"_top_{n}") for n in names})
    out = x.join(carry, [*keys, "_sb"])
    out = out.withColumns({n: F.col(f"_y_{n}") + F.col(f"_p_{n}") * F.col(f"_in_{n}") for n in names})
    return out.drop("_sb", "_at", *[f"{s}_{n}" for n in names for s in ("_p", "_y", "_in")])

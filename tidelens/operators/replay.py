"""Recurrences that branch on their own state, run block by block.

Parabolic SAR, supertrend, volume buckets and trade replays cannot be composed like
affine maps. A series is still not put in one task: all blocks run at once from a
guessed entering state, then every block whose predecessor ended in another state than
the one it was given is run again, until nothing changes. The fixed point is the
sequential result; how many rounds it takes depends on how fast the state forgets.
Only end states (a few numbers per block) are exchanged between rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

REPLAY_ROWS = 100_000


def _key_schema(df: DataFrame, keys) -> list:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def replay(
    df: DataFrame,
    step: Callable,
    inputs: list[str],
    outputs: dict[str, T.DataType],
    keys=("symbol",),
    rows: int | None = None,
) -> DataFrame:
    """Run ``step(columns, state) -> (output columns, state)`` over each series in order.

    ``columns`` maps input names (and ``_rn``) to numpy arrays of consecutive rows;
    ``state`` is a list of floats, or None before the first row. ``df`` needs ``_rn``.
    Returns keys, ``_rn`` and the outputs.
    """
    rows, keys = rows or REPLAY_ROWS, list(keys)
    x = df.select(*keys, "_rn", *inputs).withColumn("_blk", F.floor((F.col("_rn") - 1) / rows).cast("long"))
    at = [*keys, "_blk"]
    state_schema = T.StructType([*_key_schema(df, keys), T.StructField("_blk", T.LongType()),
                                 T.StructField("_end", T.ArrayType(T.DoubleType()))])

    def _run(pdf: pd.DataFrame):
        pdf = pdf.sort_values("_rn")
        start = pdf["_state"].iloc[0] if "_state" in pdf.columns else None
        cols = {n: pdf[n].to_numpy() for n in ["_rn", *inputs]}
        return pdf, step(cols, None if start is None else [float(v) for v in start])

    def end_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, (_, end) = _run(pdf)
        row = pdf[at].iloc[[0]].copy()
        row["_end"] = [None if end is None else [float(v) for v in end]]
        return row

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, (out, _) = _run(pdf)
        res = pdf[[*keys, "_rn"]].copy()
        for n in outputs:
            res[n] = out[n]
        return res

    out_schema = T.StructType([*_key_schema(df, keys), T.StructField("_rn", T.LongType()),
                               *[T.StructField(n, t) for n, t in outputs.items()]])
    x = cut_lineage(x.withColumn("_rn", F.col("_rn").cast("long")))  # every round and the last pass read it again
    if not x.agg(F.max("_blk").alias("m")).filter("m > 0").take(1):
        return x.groupBy(*at).applyInPandas(emit, out_schema)

    prev = Window.partitionBy(*keys).orderBy("_blk")
    ends = cut_lineage(x.groupBy(*at).applyInPandas(end_of, state_schema).withColumn(
        "_used", F.lit(None).cast("array<double>")))
    while True:
        linked = ends.withColumn("_in", F.lag("_end").over(prev))
        stale = linked.filter(~F.col("_in").eqNullSafe(F.col("_used"))).select(*at, "_in")
        stale = cut_lineage(stale)
        if stale.isEmpty():
            break
        again = (
            x.join(stale.withColumnRenamed("_in", "_state"), at)
            .groupBy(*at).applyInPandas(end_of, state_schema)
            .join(stale.withColumnRenamed("_in", "_used"), at)
        )
        ends = cut_lineage(ends.join(stale.select(*at), at, "left_anti").unionByName(again))
    starts = ends.select(*at, F.col("_used").alias("_state"))
    return x.join(starts, at).groupBy(*at).applyInPandas(emit, out_schema)

"""Join forms the domain needs, all as equi-joins or aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_known


def latest(df: DataFrame, keys: list[str], order: list[str], cutoff: Column | None = None) -> DataFrame:
    """Newest row per key (at or before ``cutoff``): one aggregate with map-side combine."""
    if cutoff is not None:
        df = df.filter(F.col(order[0]) <= cutoff)
    rest = [n for n in df.columns if n not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def asof(probes: DataFrame, series: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """For each probe row the last series row at or before its time.

    Probes and series are laid in one ordered stream and the last series row is carried
    forward, so there is no range join and no task holds a whole key.
    """
    p = probes.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(_struct_type(series, columns))})
    s = series.select(F.col(key), F.col(time), F.struct(*columns).alias("_v")).withColumn("_side", F.lit(0))
    both = p.unionByName(s, allowMissingColumns=True)
    both = last_known(both, [key], [time, "_side"], "_v", "_last")
    return both.filter("_side = 1").select(*probes.columns, *[F.col("_last")[n].alias(n) for n in columns])


def _struct_type(df: DataFrame, columns: list[str]) -> str:
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()


def touch_either(facts: DataFrame, left: str, right: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose ``left`` OR ``right`` is in ``dim``: two equi-joins and a union, never an OR join."""
    a = facts.join(dim.withColumnRenamed(key, left), left).withColumns({"owner": F.col(left), "side": F.lit("source")})
    b = facts.join(dim.withColumnRenamed(key, right), right).withColumns({"owner": F.col(right), "side": F.lit("destination")})
    return a.unionByName(b, allowMissingColumns=True)


def outer_merge(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of several sources; the first keeps its names, others get ``_{source}``."""
    out = None
    for i, (name, df) in enumerate(frames.items()):
        if i:
            df = df.withColumnsRenamed({n: f"{n}_{name}" for n in df.columns if n not in keys})
        out = df if out is None else out.join(df, keys, "full_outer")
    return out


def attach(base: DataFrame, sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left join of side series, columns prefixed with the series name."""
    for name, df in sides.items():
        df = df.withColumnsRenamed({n: f"{name}_{n}" for n in df.columns if n not in keys})
        base = base.join(df, keys, "left")
    return base


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, label: str) -> DataFrame:
    """Foreign-key audit: count of child rows and distinct keys without a parent."""
    lost = child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return lost.agg(F.lit(label).alias("key"), F.count(F.lit(1)).alias("orphan_rows"), F.count_distinct(fk).alias("orphan_keys"))

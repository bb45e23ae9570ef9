"""Mixing sources to target weights: a minimum-cost flow over membership patterns, then seeded whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelens.llm.flow import Flow
from tidelens.llm.native import store

WORD = r"[^\x20\x09-\x0D]+"
SMALL = 10_000  # patterns up to which their table is broadcast


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: dict, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, cap: float = 2.0) -> dict:
    """Source -> words wanted: ``total_share`` of all sizes split by weight (dealt in code point order, null last), no source above
    ``cap`` times its size; what is above goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, open_ = total_share * sum(sizes.values()), {}, list(order)
    while open_:
        left = budget - sum(target.values())
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            return target | share
        target |= {s: float(cap * sizes[s]) for s in full}
        open_ = [s for s in open_ if s not in target]
    return target


def route(patterns: list[tuple[tuple, int]], targets: dict, max_copies: int) -> list[list[tuple]]:
    """Per pattern the pieces (source, from, to) of its words, laid end to end over up to ``max_copies`` rounds.

    Each further round of a pattern costs one more per word, so repetition is spread as evenly as the quotas allow."""
    flow, arcs = Flow(), []
    for s, t in targets.items():
        flow.add(("source", s), "sink", round(t))
    for i, (members, words) in enumerate(patterns):
        for k in range(max_copies):
            flow.add("start", ("pattern", i), words, k)
        arcs.append([(s, flow.add(("pattern", i), ("source", s), words * max_copies)) for s in members if s in targets])
    flow.run("start", "sink")
    pieces = []
    for row in arcs:
        at, own = 0, []
        for s, arc in row:
            if used := flow.used(arc):
                own.append((s, at, at + used))
                at += used
        pieces.append(own)
    return pieces


def mix(docs: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", weights: Sequence[float] = (3, 1, 2),
        total_share: float = 1.5, max_copies: int = 2, seed: int = 17, targets=None, bucket_rows: int = 2_000) -> DataFrame:
    """Choose documents so that each source's words come near its target.

    ``sources`` is an array of the sources that hold the document (a null entry is a source of its own), ``size`` its words.
    Documents are aggregated by membership pattern; a minimum-cost flow sends the patterns' words to the sources' quotas, where
    every further copy costs more; within a pattern documents stand in the order of md5(seed:id) and a document goes to the source
    in whose piece its middle lies, whole, at most once a round. ``targets`` maps sizes of sources to wanted words
    (``share_targets`` if not given).

    Returns doc_id, sources (sorted), size, uses (array of source and words, one entry for each copy), taken (words of all copies)
    and the maps source_sizes and source_targets of its sources (arrays in the order of ``sources``). Documents without a source
    or words take part with nothing taken. Rows sharing an id are separate documents. Only totals by pattern reach the driver; the
    running sums are cut into hash ranges of about ``bucket_rows`` rows, so no pattern is sorted in one task.
    """
    base = store(docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("sources"),
                       F.coalesce(size, F.lit(0)).cast("long").alias("size")))
    found = base.groupBy("sources").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    patterns = [(tuple(r["sources"]), r["words"]) for r in sorted(found, key=lambda r: [(s is None, s or "") for s in r["sources"]])]
    sizes: dict = {}
    for members, words in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    wanted = targets(sizes) if targets else share_targets(sizes, weights, total_share, float(max_copies))
    pieces = route(patterns, wanted, max_copies)
    rows = [(list(m), words, [(s, a, b) for s, a, b in own], [sizes[s] for s in m], [float(wanted[s]) for s in m])
            for (m, words), own in zip(patterns, pieces)]
    table = docs.sparkSession.createDataFrame(
        rows, "p array<string>, words long, pieces array<struct<source string, lo long, hi long>>, source_sizes array<long>, source_targets array<double>")
    bits = max(0, (max([r["n"] for r in found], default=0) // bucket_rows).bit_length())
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    hashed = base.withColumn("h", h).withColumn("b", F.shiftright("h", 60 - bits) if bits else F.lit(0).cast("long"))
    ranges = hashed.groupBy("sources", "b").agg(F.sum("size").alias("s"))
    before = ranges.select("sources", "b", (F.sum("s").over(Window.partitionBy("sources").orderBy("b")) - F.col("s")).alias("ahead"))
    inside = Window.partitionBy("sources", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (hashed.withColumn("run", F.sum("size").over(inside) - F.col("size")).join(before, ["sources", "b"])
              .withColumn("mid", F.col("ahead") + F.col("run") + F.col("size") / 2))
    found_table = F.broadcast(table) if len(rows) <= SMALL else table
    joined = placed.join(found_table, placed["sources"] == table["p"])

    def copy(k: Column) -> Column:
        at = k * F.col("words") + F.col("mid")
        return F.get(F.filter("pieces", lambda x: (x["lo"] <= at) & (at < x["hi"])), F.lit(0))

    uses = F.when(F.col("size") > 0, F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_copies - 1)), copy), lambda x: x.isNotNull()))
    uses = F.transform(F.coalesce(uses, F.array().cast("array<struct<source:string,lo:bigint,hi:bigint>>")),
                       lambda x: F.struct(x["source"].alias("source"), F.col("size").alias("words")))
    return joined.select("doc_id", "sources", "size", uses.alias("uses"), "source_sizes", "source_targets").withColumn(
        "taken", (F.size("uses") * F.col("size")).cast("long"))

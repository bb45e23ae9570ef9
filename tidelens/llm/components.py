"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidelens.llm.native import store


class Forest:
    """Union-find over the numbers 0 to n-1; the smallest number of a set is its root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its set) that keep the sets which the given edges connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(nodes))
    for i, j in zip(at[:len(u)].tolist(), at[len(u):].tolist()):
        forest.join(i, j)
    root = np.array([forest.find(i) for i in range(len(nodes))], dtype=np.int64)
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v long): root is the smallest node that edges connect it with.

    Each round hangs every node's larger neighbours and then its smaller ones on the smallest it sees, until nothing changes. Minima
    are pre-aggregated before the shuffle, and a node with many neighbours is split by the skew join. Every round is written to the
    shared folder. Edges with a null end are ignored.
    """
    now = store(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = store(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

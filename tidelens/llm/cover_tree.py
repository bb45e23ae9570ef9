"""Near-duplicate embeddings with a cover tree walked against itself: every pair over a cosine threshold, none below."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType

from tidelens.llm.components import Forest, components
from tidelens.llm.native import NO_ID, store

SAFE = 1e-9  # bounds closer than this to the threshold are settled by the exact cosine
PIVOTS = 16


@F.arrow_udf(BinaryType())
def packed(column: pa.Array) -> pa.Array:
    """Vectors as doubles, scaled by a power of two so that the largest part is below 1; null for null, zero or non-finite ones."""
    column = column.cast(pa.list_(pa.float64()))
    values = column.values.to_numpy(zero_copy_only=False)  # null parts are NaN
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for i in range(len(column)):
        x = values[offsets[i]:offsets[i + 1]] if valid[i] else values[:0]
        top = np.abs(x).max() if len(x) else 0.0
        out.append((np.ldexp(x, -math.frexp(top)[1]) + 0.0).tobytes() if 0 < top < np.inf else None)
    return pa.array(out, pa.binary())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class CoverTree:
    """Nested nets: the children of a node stand within half its scale, the first child on the node's own centre.

    Points are put in tree order; node i covers points start[i] to stop[i], all within radius[i] (measured) of its centre, and has
    the children child[i] to child_stop[i]. Points are nodes without children and radius 0.
    """

    def __init__(self, x: np.ndarray, least: float) -> None:
        self.center, self.radius, self.start, self.stop, self.child, self.child_stop = [], [], [], [], [], []
        order = []
        waiting = [(np.arange(len(x)), 0, 2.0, self._new(0))]
        inner = {}
        while waiting:
            idx, c, scale, node = waiting.pop()
            d = self._far(x, c, idx)
            self.radius[node] = float(d.max()) if len(idx) > 1 else 0.0
            if len(idx) == 1:
                continue
            kids, rest, half = [], idx, scale / 2
            if self.radius[node] <= least / 4 or len(idx) <= 8:
                kids = [(idx[i:i + 1], int(idx[i])) for i in range(len(idx))]
            else:
                while half >= self.radius[node]:
                    half /= 2
                at = c
                while len(rest):
                    near = self._far(x, at, rest) <= half
                    near[rest == at] = True
                    kids.append((rest[near], at))
                    rest = rest[~near]
                    at = int(rest[0]) if len(rest) else 0
            first = len(self.center)
            inner[node] = [(m, k, half, self._new(k)) for m, k in kids]
            self.child[node], self.child_stop[node] = first, first + len(kids)
            waiting += inner[node][::-1]
        self._lay(inner, order, 0)
        self.order = np.array(order)
        for name in ("center", "start", "stop", "child", "child_stop"):
            setattr(self, name, np.array(getattr(self, name)))
        self.radius = np.array(self.radius)

    def _new(self, c: int) -> int:
        self.center.append(c)
        self.radius.append(0.0)
        for part in (self.start, self.stop, self.child, self.child_stop):
            part.append(0)
        return len(self.center) - 1

    @staticmethod
    def _far(x: np.ndarray, c: int, idx: np.ndarray) -> np.ndarray:
        d = x[idx] - x[c]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _lay(self, inner: dict, order: list, root: int) -> None:
        stack = [(root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                self.stop[node] = len(order)
                continue
            self.start[node] = len(order)
            if node not in inner:
                order.append(self.center[node])
                self.stop[node] = len(order)
                continue
            stack.append((node, True))
            stack += [(k[3], False) for k in reversed(inner[node])]


class Cell:
    """The vectors of a leaf of the distributed tree in the order of their own cover tree."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, eps: float) -> None:
        unit = _unit(x)
        self.tree = CoverTree(unit, eps)
        o = self.tree.order
        self.ids, self.copies, self.x, self.c = ids[o], copies[o], x[o], unit[self.tree.center]
        self.before = np.concatenate([[0], np.cumsum(self.copies)])


def walk(a: Cell, b: Cell, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Copies linked with each vector of both cells, and edges that connect what is linked. ``a`` may be ``b``: then each pair once.

    Pairs of nodes are dropped when their centres are further apart than radii and threshold together, taken whole when even their
    farthest points are within the threshold, and otherwise opened; pairs of points too close to call by distance get the cosine."""
    own, eps = a is b, math.sqrt(2 - 2 * cosine)
    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    shift = 0 if own else len(a.ids)
    forest, edges = Forest(len(a.ids) + (0 if own else len(b.ids))), []
    ids = a.ids if own else np.concatenate([a.ids, b.ids])

    def link(i: int, j: int) -> None:
        if forest.join(i, j):
            edges.append((int(ids[i]), int(ids[j])))

    stack, ta, tb = [(0, 0)], a.tree, b.tree
    while stack:
        p, q = stack.pop()
        kids_a = np.arange(ta.child[p], ta.child_stop[p]) if ta.child_stop[p] > ta.child[p] else np.array([p])
        kids_b = np.arange(tb.child[q], tb.child_stop[q]) if tb.child_stop[q] > tb.child[q] else np.array([q])
        same = own and p == q
        if len(kids_a) == 1 and len(kids_b) == 1 and kids_a[0] == p and kids_b[0] == q and same:
            continue
        for lo in range(0, len(kids_a), 1024):
            part = kids_a[lo:lo + 1024]
            d = np.sqrt(np.maximum(2 - 2 * (a.c[part] @ b.c[kids_b].T), 0))
            reach = ta.radius[part][:, None] + tb.radius[kids_b][None, :]
            live = d <= reach + eps + 1e-7
            if same:
                live &= np.arange(lo, lo + len(part))[:, None] <= np.arange(len(kids_b))[None, :]
            i, j = np.nonzero(live)
            u, v, dist, r = part[i], kids_b[j], d[i, j], reach[i, j]
            twin = (u == v) if own else np.zeros(len(u), bool)
            points = (ta.child_stop[u] == ta.child[u]) & (tb.child_stop[v] == tb.child[v])
            for k in np.flatnonzero(points & ~twin):
                s, t = ta.start[u[k]], tb.start[v[k]]
                if abs(dist[k] - eps) < 1e-6:
                    y, z = a.x[s], b.x[t]
                    linked = float(y @ z) / (math.sqrt(float(y @ y)) * math.sqrt(float(z @ z))) >= cosine
                else:
                    linked = dist[k] < eps
                if linked:
                    na[s] += b.copies[t]
                    nb[t] += a.copies[s]
                    link(s, shift + t)
            wide = np.where(twin, 2 * ta.radius[u], dist + r)
            whole = ~points & (wide <= eps - 1e-6)
            for k in np.flatnonzero(whole):
                s, e, t, f = ta.start[u[k]], ta.stop[u[k]], tb.start[v[k]], tb.stop[v[k]]
                if twin[k]:
                    na[s:e] += a.before[e] - a.before[s] - a.copies[s:e]
                    for m in range(s + 1, e):
                        link(s, m)
                else:
                    na[s:e] += b.before[f] - b.before[t]
                    nb[t:f] += a.before[e] - a.before[s]
                    for m in range(s, e):
                        link(m, shift + t)
                    for m in range(t + 1, f):
                        link(s, shift + m)
            for k in np.flatnonzero(~points & ~whole):
                stack.append((int(u[k]), int(v[k])))
    return (na + nb if own else na), nb, edges


def _gather(key, pdf, eps: float):
    """One row for each cell: its vectors with their cover tree, pickled."""
    pdf = pdf.sort_values("d")
    x = np.frombuffer(b"".join(pdf["v"]), float).reshape(len(pdf), -1)
    cell = Cell(pdf["d"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), x, eps)
    return pd.DataFrame({"node": [key[0]], "cell": [pickle.dumps(cell, protocol=5)]})


def _links(frames, cosine: float, own: bool) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out, last, left = [pd.DataFrame({"u": [], "v": [], "n": []}, dtype="Int64")], None, None
        for r in pdf.itertuples(index=False):
            if r.a_cell != last:
                last, left = r.a_cell, pickle.loads(r.a_cell)
            a, b = left, left if own else pickle.loads(r.b_cell)
            na, nb, edges = walk(a, b, cosine)
            for cell, n in ((a, na),) if own else ((a, na), (b, nb)):
                some = n > 0
                out.append(pd.DataFrame({"u": cell.ids[some], "v": pd.array([None] * int(some.sum()), "Int64"), "n": n[some]}))
            if edges:
                out.append(pd.DataFrame({"u": [e[0] for e in edges], "v": [e[1] for e in edges], "n": 0}))
        yield pd.concat(out).astype("Int64")


def _assign(batches) -> Iterator[pa.RecordBatch]:
    """Each vector's nearest pivot of its node, and the distance to it."""
    for batch in batches:
        best, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        v, pivots, node = batch.column("v"), batch.column("pivots"), batch.column("node").to_numpy()
        for k in np.unique(node):
            rows = np.flatnonzero(node == k)
            c = _unit(np.stack([np.frombuffer(p, float) for p in pivots[rows[0]].as_py()]))
            x = _unit(np.frombuffer(b"".join(v.take(pa.array(rows)).to_pylist()), float).reshape(len(rows), -1))
            d = np.stack([np.sqrt(((x - y) ** 2).sum(axis=1)) for y in c], axis=1)
            best[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "copies", "v", "node")] + [pa.array(best), pa.array(far)], ["d", "copies", "v", "node", "pick", "far"])


@F.arrow_udf(DoubleType())
def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distance of unit vectors along two columns of packed vectors."""
    out = [float(np.sqrt(((_unit(np.frombuffer(x, float)[None]) - _unit(np.frombuffer(y, float)[None])) ** 2).sum())) for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(out, pa.float64())


def _split(points: DataFrame, cell: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf, and per level the nodes (parent, node, center, radius).

    A node of more than ``cell`` points gets two for each ``cell`` of them, at most PIVOTS, as centres of children; what is still too large after ``depth``
    levels is dealt by hash among equal nodes, so that no leaf is unbounded."""
    levels = []
    for level in range(depth + 1):
        counts = points.groupBy("node").agg(F.count("*").alias("n"))
        large = store(counts.filter(F.col("n") > cell))
        if not large.head(1):
            break
        if level == depth:
            dealt = points.join(large, "node").withColumn("parent", F.col("node")).withColumn(
                "node", F.xxhash64("node", F.pmod(F.xxhash64("d", F.lit(7)), F.ceil(F.col("n") / cell))))
            dealt = store(dealt.select("parent", "node", "d", "copies", "v"))
            levels.append(store(dealt.select("parent", "node", F.lit(None).cast("binary").alias("center"), F.lit(None).cast("double").alias("radius")).distinct()))
            points = store(points.join(large.select("node"), "node", "left_anti").select("d", "copies", "v", "node").union(dealt.select("d", "copies", "v", "node")))
            break
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("d", F.lit(level)), "d"))
        pivots = points.join(large, "node").select("node", "n", "d", "v").withColumn("rank", rank).filter((F.col("rank") <= PIVOTS) & (F.col("rank") <= F.ceil(2 * F.col("n") / cell))).groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("p")).select("node", F.col("p.v").alias("pivots"))
        pivots = store(pivots)
        picked = store(points.join(pivots, "node").select("d", "copies", "v", "node", "pivots").mapInArrow(
            _assign, "d long, copies long, v binary, node long, pick int, far double"))
        child = F.xxhash64("node", "pick", F.lit(level))
        made = picked.groupBy("node", "pick").agg(F.max("far").alias("radius")).join(pivots.select("node", "pivots"), "node").select(
            F.col("node").alias("parent"), child.alias("node"), F.get("pivots", F.col("pick")).alias("center"), "radius")
        levels.append(store(made))
        stay = points.join(large.select("node"), "node", "left_anti").select("d", "copies", "v", "node")
        points = store(stay.union(picked.select("d", "copies", "v", child.alias("node"))))
    return points, levels


def near_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", block: Column | None = None, cosine: float = 0.98,
               cell: int = 1_500, depth: int = 4) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links have a cosine of at least ``cosine`` in double precision.

    Only rows of an equal, non-null ``block`` (all, if not given) and an equal number of parts are compared. Vectors that are null,
    zero, or hold null or non-finite parts are linked with nothing. Equal vectors are one point with a number of copies, which count
    as links of each other. A null id counts as the smallest; rows sharing an id are separate vectors that share its component.

    A distributed tree cuts each block into cells of about ``cell`` points (a larger block makes more of them); pairs of its nodes are
    followed down from the roots while their covering radii allow a link, and the cells that remain are walked tree against tree.
    """
    base = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), (F.lit(0) if block is None else block).cast("string").alias("b"), packed(vector_col).alias("v"))
    base = store(base)
    valid = base.filter("b IS NOT NULL AND v IS NOT NULL")
    classes = store(valid.groupBy("b", "v").agg(F.min("d").alias("d"), F.count("*").alias("copies")))
    roots = classes.select("d", "copies", "v", F.xxhash64("b", F.octet_length("v")).alias("node"))
    leaves, levels = _split(store(roots), cell, depth)
    eps = math.sqrt(2 - 2 * cosine)
    cells = store(leaves.groupBy("node").applyInPandas(lambda key, pdf: _gather(key, pdf, eps), "node long, cell binary"))
    pairs = roots.select(F.col("node").alias("a")).distinct().withColumn("b", F.col("a"))
    for made in levels:
        a, b = (made.select(F.col("parent").alias(x), F.col("node").alias(f"{x}2"), F.col("center").alias(f"{x}_c"), F.col("radius").alias(f"{x}_r")) for x in "ab")
        opened = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"x": F.coalesce("a2", "a"), "y": F.coalesce("b2", "b")})
        opened = opened.filter((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
        known = F.col("a_c").isNotNull() & F.col("b_c").isNotNull()
        reach = F.col("a_r") + F.col("b_r") + math.sqrt(2 - 2 * cosine) + SAFE * 100
        apart = distance(F.coalesce("a_c", "b_c", F.lit(np.ones(1).tobytes())), F.coalesce("b_c", "a_c", F.lit(np.ones(1).tobytes())))
        pairs = store(opened.withColumn("apart", apart).filter(~known | (F.col("apart") <= reach)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    met = _meet(cells, pairs, cosine)
    links = met.filter("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    tops = components(met.filter("v IS NOT NULL").select("u", "v"))
    facts = classes.select("b", "v", F.col("d").alias("rep"), "copies").join(links, "rep", "left").join(tops, F.col("rep") == F.col("node"), "left").select(
        "b", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("c"))
    out = base.join(facts, ["b", "v"], "left").select("d", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "d").alias("c"))
    restore = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(restore("d").alias("vec_id"), "n_links", restore("c").alias("component_id"), (F.col("d") == F.col("c")).alias("kept"))


def _meet(cells: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """Walks of every cell with itself and of the pairs of cells that remain."""
    inner = cells.select(F.col("cell").alias("a_cell")).mapInPandas(lambda it: _links(it, cosine, True), "u long, v long, n long")
    left, right = (cells.select(F.col("node").alias(x), F.col("cell").alias(f"{x}_cell")) for x in "ab")
    outer = pairs.filter("a <> b").join(left, "a").join(right, "b").drop("a", "b").mapInPandas(lambda it: _links(it, cosine, False), "u long, v long, n long")
    return store(inner.union(outer))

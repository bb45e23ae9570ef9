"""Checks, imputation, outliers and scaling.

A fitted statistic is always a one-row (or one-row-per-column) DataFrame, so it can be
saved beside the data and applied to other data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, div
from ..functions.rolling import lag
from ..functions.sieve import sieve
from ..session import cut_lineage, stored
from .quantile import exact_quantiles
from .series import blocks, prefix, unblock


def require_columns(df: DataFrame, needed) -> DataFrame:
    missing = [n for n in needed if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def long_form(df: DataFrame, columns: list[str], keep=()) -> DataFrame:
    """(keep..., column, value) rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("value")) for n in columns])
    return df.select(*keep, F.inline(cells))


def null_share(df: DataFrame, columns: list[str], minimum_rows: int = 100, limit: float = 0.1) -> DataFrame:
    """Row count, null count and share per column with the pass flag; one scan."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(n).isNull()).alias(f"_{n}") for n in columns])
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_{n}").alias("nulls")) for n in columns])
    share = F.coalesce(div("nulls", "rows"), F.lit(0.0))
    return row.select("rows", F.inline(cells)).select(
        "column", "rows", "nulls", share.alias("share"), ((F.col("rows") >= minimum_rows) & (share <= limit)).alias("ok"))


def drop_sparse(df: DataFrame, columns: list[str], limit: float = 0.3) -> DataFrame:
    """Drops columns whose null share is over ``limit``; the decision is one small row."""
    stats = null_share(df, columns, 0, limit).filter(~F.col("ok")).select("column").collect()  # at most one row per column
    return df.drop(*[r["column"] for r in stats])


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles of several columns: one row per column."""
    return exact_quantiles(long_form(df, columns), ["column"], "value", probs, names)


def column_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_form(df, columns).groupBy("column").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.stddev_pop("value").alias("std_pop"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def outlier_share(df: DataFrame, columns: list[str], width: float = 3.0, limit: float = 0.01) -> DataFrame:
    q = column_quantiles(df, columns, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - width * iqr) | (F.col("value") > F.col("q3") + width * iqr)
    r = long_form(df, columns).join(F.broadcast(q), "column").groupBy("column").agg(
        F.count_if(out).alias("outliers"), div(F.count_if(out), F.count(F.lit(1))).alias("share"))
    return r.withColumn("report", F.col("share") > limit)


def steps(numbered: DataFrame) -> DataFrame:
    """Seconds since the previous row of each series."""
    x = blocks(numbered, 1)
    return unblock(x.withColumn("step", F.unix_timestamp("ts") - F.unix_timestamp(lag("ts"))))


def gaps(numbered: DataFrame, factor: float = 3.0) -> DataFrame:
    """Rows whose step is more than ``factor`` times the median step of the series."""
    s = steps(numbered)
    med = exact_quantiles(s, ["symbol"], "step", [0.5], ["median_step"])
    return s.join(med, "symbol").filter(F.col("step") > factor * F.col("median_step")).select("symbol", "ts", "step", "median_step")


def duplicate_times(df: DataFrame, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Repeats per series, counted from (key, time) groups so no distinct set is held."""
    per = df.groupBy(key, time).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(key).agg(F.sum("_c").alias("rows"), F.sum(F.col("_c") - 1).alias("duplicates"))


# --- imputation -------------------------------------------------------------------


def fill_both(numbered: DataFrame, columns: list[str]) -> DataFrame:
    """Forward then backward fill in time order."""
    x = prefix(numbered, {f"_f_{n}": ("last", F.col(n)) for n in columns})
    x = prefix(x, {f"_b_{n}": ("last", F.col(n)) for n in columns}, reverse=True)
    x = x.withColumns({n: F.coalesce(F.col(f"_f_{n}"), F.col(f"_b_{n}")) for n in columns})
    return x.drop(*[f"_{s}_{n}" for n in columns for s in "fb"])


def fill_linear(numbered: DataFrame, columns: list[str]) -> DataFrame:
    """Linear by row position between known values; the edges take the nearest one."""
    specs = {f"_{n}": ("last", F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("v"), F.col("_rn").alias("r")))) for n in columns}
    x = prefix(numbered, {f"_p{k}": s for k, s in specs.items()})
    x = prefix(x, {f"_q{k}": s for k, s in specs.items()}, reverse=True)
    fixed = {}
    for n in columns:
        a, b = F.col(f"_p_{n}"), F.col(f"_q_{n}")
        inner = a["v"] + (b["v"] - a["v"]) * div(F.col("_rn") - a["r"], b["r"] - a["r"])
        fixed[n] = F.coalesce(F.col(n), inner, a["v"], b["v"])
    x = x.withColumns(fixed)
    return x.drop(*[f"_{s}_{n}" for n in columns for s in "pq"])


def fill_with(df: DataFrame, columns: list[str], stat: str = "mean") -> DataFrame:
    """Mean or exact median per column, as scalars."""
    if stat == "mean":
        st = column_moments(df, columns).select("column", F.col("mean").alias("m"))
    else:
        st = column_quantiles(df, columns, [0.5], ["m"])
    return _apply(df, st, columns, ["m"], lambda x, s: F.coalesce(x, s["m"]))


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value (ties by value), counted as groups; rows still null are dropped."""
    for n in columns:
        top = df.filter(F.col(n).isNotNull()).groupBy(n).agg(F.count(F.lit(1)).alias("_c"))
        best = top.agg(F.max_by(n, F.struct("_c", n))).scalar()
        df = df.withColumn(n, F.coalesce(F.col(n), best))
    return df.dropna()


AXES = 3  # observed columns that donors are cut along
BORDER_ROWS = 1_000_000  # points, of all trees, that place the borders of cells
CHUNK = 1_000_000  # distances that are held at once
HELD = 100_000  # donors of a task that are placed together
ASKED = 20_000  # rows of a cell that one task takes, about


def _shape(points, cells: int) -> tuple[int, ...]:
    """Parts along each axis such that cells are about as long as wide: a small box then meets few of them."""
    import numpy as np

    axes = points.shape[1]
    wide = np.nan_to_num(np.subtract(*np.quantile(points, [0.95, 0.05], axis=0)), nan=0.0, posinf=1e300) if len(points) else np.zeros(axes)
    left, size = np.flatnonzero(wide > 0), np.zeros(axes)
    if not len(left):
        return (max(1, round(cells ** (1 / axes))),) * axes
    while len(left):
        log = np.log(wide[left])
        size[left] = np.exp(log + (np.log(cells) - log.sum()) / len(left))
        short = left[size[left] < 1]
        size[short], left = 1, np.setdiff1d(left, short)
        if not len(short):
            break
    return tuple(max(1, int(round(x))) for x in size)


def _cut(points, parts, axis: int = 0):
    """Borders along an axis, and of each strip between them the borders along the next one. ``parts``: of all axes, or of each."""
    import numpy as np

    own = parts if isinstance(parts, int) else parts[axis]
    v = np.sort(points[:, axis])
    edges = np.unique(v[[len(v) * i // own for i in range(1, own)]]) if len(v) else v
    edges = edges[edges > v[0]] if len(v) else edges
    if axis + 1 == points.shape[1]:
        return edges, None
    strip = np.searchsorted(edges, points[:, axis], "right")
    return edges, [_cut(points[strip == i], parts, axis + 1) for i in range(len(edges) + 1)]


def _cells(node, low, high, parts, rows, base: int = 0, axis: int = 0):
    """(rows, cells) of all cells that meet the boxes from ``low`` to ``high``; of a point, its own cell."""
    import numpy as np

    edges, inner = node
    first = np.searchsorted(edges, low[rows, axis], "right")
    size = np.searchsorted(edges, high[rows, axis], "right") - first + 1
    who, at = np.repeat(rows, size), np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    if inner is None:
        yield who, base + at
        return
    for i in np.unique(at):
        yield from _cells(inner[i], low, high, parts, who[at == i], (base + int(i)) * (parts if isinstance(parts, int) else parts[axis + 1]), axis + 1)


class _Cell:
    """Asked rows of one cell and the nearest of the donors that come by, in the order of their keys, a pack at a time."""

    def __init__(self, cell, k: int) -> None:
        self.cell, self.k, self.asks, self.packs, self.rows, self.best = cell, k, [], [], 0, None

    def ask(self, rows) -> None:
        self.asks.append(rows)

    def give(self, keys, v) -> None:
        if self.asks:
            self.packs.append((keys, v))
            self.rows += len(v)
            if self.rows * len(v[0]) > CHUNK // 64:
                self.fold()

    def fold(self) -> None:
        """Takes the packs in: of each asked point the distances and places of the k nearest donors so far, and these donors."""
        import numpy as np
        import pyarrow as pa

        if self.best is None:
            self.asks = [np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(*self.asks)]
            q = self.asks[1]
            self.points, self.of = np.unique(q, axis=0, return_inverse=True)
            self.of = self.of.reshape(-1)
            self.best = np.zeros((len(self.points), 0)), np.zeros((len(self.points), 0), np.int64)
            self.keys, self.v = None, np.zeros((0, q.shape[1]))
        if not self.packs:
            return
        rows, held = np.concatenate([v for _, v in self.packs]), len(self.v)
        keys = pa.concat_arrays(([] if self.keys is None else [self.keys]) + [x for x, _ in self.packs])
        v, self.packs, self.rows = np.concatenate([self.v, rows]), [], 0
        dist, place = [], []
        step = max(1, CHUNK // len(rows))
        for a in range(0, len(self.points), step):
            q = self.points[a:a + step]
            total = np.zeros((len(q), len(rows)))
            for i in range(v.shape[1]):
                gap = q[:, i, None] - rows[None, :, i]
                total += np.where(np.isnan(q[:, i, None]), 0.0, gap * gap)
            d = np.sqrt(total)
            d[np.isnan(d)] = np.inf
            d = np.concatenate([self.best[0][a:a + step], d], axis=1)
            at = np.concatenate([self.best[1][a:a + step], np.broadcast_to(held + np.arange(len(rows)), (len(q), len(rows)))], axis=1)
            m = min(self.k, d.shape[1])
            who, near = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1, None])
            order = np.lexsort((near, d[who, near], who))  # donors come in the order of their keys
            who, near = who[order], near[order]
            keep = np.arange(len(who)) - np.searchsorted(who, np.arange(len(q)))[who] < m
            who, near = who[keep], near[keep]
            dist.append(d[who, near].reshape(-1, m))
            place.append(at[who, near].reshape(-1, m))
        dist, place = np.concatenate(dist), np.concatenate(place)
        used, at = np.unique(place, return_inverse=True)
        self.best, self.keys, self.v = (dist, at.reshape(place.shape)), keys.take(pa.array(used)), v[used]


def fill_knn(df: DataFrame, columns: list[str], key: str, k: int = 5, cell: int = 500) -> DataFrame:
    """Missing cells take the mean of the ``k`` nearest complete rows on the observed columns (ties: the smaller key).

    Exact over all donors, and nothing is sampled but the places of borders. Rows that observe the same columns (the first ``AXES`` of
    them) share a tree: donors cut along these columns in turn into cells of about ``cell`` rows, as long as wide. Of donors that are
    equal there, only the ``k`` smallest keys can be among the nearest. Rows meet the donors of their own cell in one sorted stream; the
    k-th distance found there bounds, on every one of these columns, which other cells are opened. Rows that open none are done; the
    others meet the donors of the cells they open, and of those only what is as near as the bound comes back. Rows that observe the
    same values are compared once. Rows that share a key share their nearest. A row with nothing observed takes the donors' means;
    without donors cells stay null.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(columns)
    x = df.select(F.col(key).alias("_k"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))
    whole = ~F.exists("_v", lambda v: v.isNull())
    donors, holes = x.filter(whole), x.filter(~whole)
    facts = donors.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("_v")[i]).alias(f"m{i}") for i in range(n)]).first()
    back = lambda d, v: d.select(F.col("_k").alias(key), *[F.col(v)[i].alias(c) for i, c in enumerate(columns)])
    if not facts["n"]:
        return back(x, "_v")
    key_type = df.schema[key].dataType.simpleString()
    seen = F.filter(F.transform("_v", lambda v, i: F.when(v.isNotNull() & ~F.isnan(v), i)), lambda i: i.isNotNull())
    named = F.when(F.size(seen) > 0, F.concat(F.array_join(F.slice(seen, 1, AXES), ","), F.when(F.size(seen) > AXES, "+").otherwise("")))  # a tree; none with nothing observed
    holes = holes.withColumn("_t", F.coalesce(F.when(F.col("_k").isNotNull(), named), F.lit("")))
    trees = {r["_t"]: [int(i) for i in r["_t"].rstrip("+").split(",")] for r in holes.filter("_t <> ''").select("_t").distinct().collect()}
    means = [facts[f"m{i}"] for i in range(n)]
    mean_of = lambda i: F.when(F.size("near") > 0, F.aggregate("near", F.lit(0.0), lambda t, r: t + r["v"][i]) / F.size("near"))
    filled = F.array(*[F.coalesce(F.col("_v")[i], mean_of(i), F.lit(means[i])) for i in range(n)])
    near_type = f"array<struct<d: double, z: boolean, k: {key_type}, v: array<double>>>"
    plain = holes.filter("_t = ''").select("_k", "_v", F.lit(None).cast(near_type).alias("near"))
    if not trees:
        return back(donors.unionByName(plain.select("_k", filled.alias("_v"))), "_v")

    names = sorted(trees)
    spots = F.array(*[F.struct(F.lit(t).alias("_t"), F.array(*[F.col("_v")[i] for i in trees[t]]).alias("_p")) for t in names])
    rate = min(1.0, BORDER_ROWS / len(trees) / facts["n"])
    points = donors.select("_k", F.inline(spots)).filter(~F.exists("_p", lambda v: F.isnan(v)) & (F.pmod(F.xxhash64("_k", "_p"), F.lit(1_000_000)) < int(rate * 1_000_000))).select("_t", "_p").toPandas()
    cuts, bases = {}, [0]
    for t in names:
        own = np.array(points["_p"][points["_t"] == t].tolist(), dtype=float).reshape(-1, len(trees[t]))
        parts = _shape(own, max(1, min(facts["n"] // cell, len(own) // (k + 8))))
        cuts[t] = (_cut(own, parts), parts)
        bases.append(bases[-1] + int(np.prod(parts)))
    del points
    base = dict(zip(names, bases))
    cols = [f"_v{i}" for i in range(n)]
    row_type = f"_c long, _w int, _k {key_type}, {', '.join(f'{c} double' for c in cols)}, _far double"  # _w: share of the cell's rows, donor, repeated key

    def matrix(b, name):
        """A column of arrays of ``n`` numbers, with NaN for null."""
        return b.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)

    def placed(t, p):
        out = np.zeros(len(p), np.int64)
        for who, c in _cells(cuts[t][0], p, p, cuts[t][1], np.arange(len(p))):
            out[who] = c
        return out + base[t]

    def out_rows(cells, w, keys, v, far):
        """``v``: a matrix with masked nulls."""
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(w.astype(np.int32)), keys, *(pa.array(v[:, i]) for i in range(n)), far], ["_c", "_w", "_k", *cols, "_far"])

    def give(batches, shares):
        """Donors with their cell in each tree. Of donors of a task that are equal there, the k smallest keys."""
        held, size = [], 0

        def flush():
            keys, v = pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held])
            sortable = pa.types.is_primitive(keys.type) or pa.types.is_string(keys.type) or pa.types.is_decimal(keys.type)
            if sortable:
                order = np.asarray(pc.sort_indices(keys, null_placement="at_end"))
                keys, v = keys.take(pa.array(order)), v[order]
            for t in names:
                p = v[:, trees[t]]
                rows = np.flatnonzero(~np.isnan(p).any(axis=1))
                if sortable and len(rows):
                    alike = v[rows] if t.endswith("+") else p[rows]
                    order = np.lexsort(alike.T)  # stable: keys stay in order
                    alike = alike[order]
                    new = np.ones(len(rows), bool)
                    new[1:] = (alike[1:] != alike[:-1]).any(axis=1)
                    start = np.flatnonzero(new)
                    rows = rows[order[np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows)))) < k]]
                if not len(rows):
                    continue
                cells = placed(t, p[rows])
                times = np.array([shares.get(c, 1) for c in cells.tolist()]) if shares else np.ones(len(rows), np.int64)
                rows, cells = np.repeat(rows, times), np.repeat(cells, times)
                share = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                yield out_rows(cells, share << 2 | 2, keys.take(pa.array(rows)), v[rows], pa.nulls(len(rows), pa.float64()))

        for b in batches:
            if b.num_rows:
                held.append((b.column("_k"), matrix(b, "_v")))
                size += b.num_rows
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def ask(batches):
        """Rows with holes, with the cell of their place."""
        for b in batches:
            tree, v, gone = np.array(b.column("_t").to_pylist()), matrix(b, "_v"), b.column("_v").flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, n)
            cells = np.zeros(b.num_rows, np.int64)
            for t in np.unique(tree) if b.num_rows else ():
                rows = np.flatnonzero(tree == t)
                cells[rows] = placed(t, v[rows][:, trees[t]])
            yield out_rows(cells, b.column("_r").to_numpy(zero_copy_only=False), b.column("_k"), np.ma.array(v, mask=gone), pa.nulls(b.num_rows, pa.float64()))

    def near_lists(c, rows, width):
        """The nearest of the asked points ``rows``; ``width``: how many of each."""
        which = np.arange(c.best[0].shape[1]) < width[:, None] if len(rows) else np.zeros((0, c.best[0].shape[1]), bool)
        d, at = c.best[0][rows][which], pa.array(c.best[1][rows][which])
        keys = c.keys.take(at) if c.keys is not None else pa.nulls(0, pa.null())
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(c.v[np.asarray(at, np.int64)].reshape(-1)))
        cells = pa.StructArray.from_arrays([pa.array(d), keys.is_null(), keys, v], ["d", "z", "k", "v"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), cells)

    def first_look(c):
        """Filled rows that are done; of others their nearest in the cell, the bound and the other cells it opens."""
        keys, q, gone, w, _ = c.asks
        t = names[int(np.searchsorted(bases, c.cell, "right")) - 1]
        dist, at = c.best
        m = dist.shape[1]
        far = dist[:, k - 1] if m >= k else np.full(len(c.points), np.inf)
        p, reach = c.points[:, trees[t]], np.where(far > 0, far * (1 + 1e-12), 0.0)[:, None]
        opened = [np.concatenate(x) for x in zip(*_cells(cuts[t][0], p - reach, p + reach, cuts[t][1], np.arange(len(p))))]
        other = opened[1] + base[t] != c.cell
        who, cells = opened[0][other], opened[1][other] + base[t]
        order = np.argsort(who, kind="stable")
        cells, first = cells[order], np.searchsorted(who[order], np.arange(len(p) + 1))
        count = np.diff(first)
        done = (count[c.of] == 0) & (w & 1 == 0)
        total = np.zeros((len(p), n))
        for j in range(m):
            total += c.v[at[:, j]]
        fill = total / m if m else np.broadcast_to(np.array(means), total.shape)
        v = np.ma.array(np.where(gone & done[:, None], fill[c.of], q), mask=gone & ~done[:, None]).reshape(-1)
        number = np.where(done, 0, count[c.of])
        take = np.repeat(first[c.of], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        lists = near_lists(c, c.of, np.where(done, 0, m))
        size = np.arange(len(q) + 1, dtype=np.int32) * n
        yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(size), pa.array(v)), pa.array(done), lists.cast(near_arrow(keys.type)), pa.array(far[c.of]),
                                          pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)).astype(np.int32)), pa.array(cells[take].astype(np.int64)))], ["_k", "_v", "_done", "near", "_far", "_open"])

    def next_look(c):
        """Donors of an opened cell that are as near as the bound."""
        keys, _, _, _, far = c.asks
        width = (c.best[0][c.of] <= far[:, None]).sum(axis=1)
        some = np.flatnonzero(width)
        if len(some):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), near_lists(c, c.of[some], width[some]).cast(near_arrow(keys.type))], ["_k", "near"])

    def near_arrow(kind):
        return pa.list_(pa.struct([("d", pa.float64()), ("z", pa.bool_()), ("k", kind), ("v", pa.list_(pa.float64()))]))

    def meet(batches, tell):
        """Rows sorted by cell and share: in each, those that ask before the donors, and these by their keys."""
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            cells, w = b.column("_c").to_numpy(), b.column("_w").to_numpy()
            gone = np.stack([b.column(c).is_null().to_numpy(zero_copy_only=False) for c in cols], axis=1)
            v = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1).astype(float)
            far = b.column("_far").to_numpy(zero_copy_only=False).astype(float)
            turn = np.flatnonzero((cells[1:] != cells[:-1]) | (w[1:] >> 1 != w[:-1] >> 1)) + 1
            for a, z in zip([0, *turn.tolist()], [*turn.tolist(), b.num_rows]):
                at = (int(cells[a]), int(w[a]) >> 2)
                if now is None or now[0] != at:
                    if now is not None and now[1].asks:
                        now[1].fold()
                        yield from tell(now[1])
                    now = (at, _Cell(at[0], k))
                keys = b.column("_k").slice(a, z - a)
                if w[a] & 2:
                    now[1].give(keys, v[a:z])
                else:
                    now[1].ask((keys, v[a:z], gone[a:z], w[a:z], far[a:z]))
        if now is not None and now[1].asks:
            now[1].fold()
            yield from tell(now[1])

    def look(asked, tell, schema):
        """What rows with a cell find in it. A cell that many ask is dealt to several tasks, each with all its donors."""
        load = asked.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ASKED).collect()  # a row for ASKED rows at most
        shares = {r["_c"]: -(-r["n"] // ASKED) for r in load}
        if shares:
            times = F.create_map(*[F.lit(int(x)).cast("long") for pair in shares.items() for x in pair])
            asked = asked.withColumn("_w", F.col("_w") + 4 * F.pmod(F.xxhash64(*cols), F.coalesce(times[F.col("_c")], F.lit(1).cast("long"))).cast("int"))
        both = asked.unionByName(donors.mapInArrow(lambda it: give(it, shares), row_type))
        share = F.shiftright("_w", 2)
        dealt = both.repartition("_c", share).sortWithinPartitions("_c", F.shiftright("_w", 1), F.col("_k").asc_nulls_last())
        return dealt.mapInArrow(lambda it: meet(it, tell), schema)

    number = F.xxhash64("_k")
    again = sieve(holes.filter("_k IS NOT NULL").select(number.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    asked = holes.filter("_t <> ''").withColumn("_r", again(number)).mapInArrow(ask, row_type)
    first = stored(look(asked, first_look, f"_k {key_type}, _v array<double>, _done boolean, near {near_type}, _far double, _open array<long>"))
    wide = first.filter(F.size("_open") > 0).select(F.explode("_open").alias("_c"), F.lit(0).alias("_w"), "_k", *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)], "_far")
    more = look(wide, next_look, f"_k {key_type}, near {near_type}").select("_k", F.lit(None).cast("array<double>").alias("_v"), "near")
    shared = F.coalesce(F.col("_k").isNotNull() & again(number), F.lit(False))
    pool = first.filter("NOT _done").select("_k", "_v", "near").unionByName(more).unionByName(plain.filter(shared))
    closest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    met = pool.groupBy("_k").agg(closest.alias("near"), F.collect_list("_v").alias("_v")).select("_k", "near", F.explode("_v").alias("_v"))
    rest = met.unionByName(plain.filter(~shared)).select("_k", filled.alias("_v"))
    return back(donors.unionByName(first.filter("_done").select("_k", "_v")).unionByName(rest), "_v")


# --- outliers ---------------------------------------------------------------------


def _apply(df: DataFrame, stats: DataFrame, columns: list[str], fields: list[str], rule) -> DataFrame:
    """Rewrites each column with its statistics, read as one scalar subquery of structs."""
    s = _wide(stats, columns, fields)
    return df.withColumns({n: rule(F.col(n).cast("double"), s[n]) for n in columns})


def _wide(stats: DataFrame, columns: list[str], fields: list[str]) -> Column:
    cells = [F.first(F.when(F.col("column") == n, F.struct(*fields)), ignorenulls=True).alias(n) for n in columns]
    return stats.agg(*cells).select(F.struct(*columns)).scalar()


def some_kinds(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``kinds``: distinct values of each column, counted up to ``most``. No more than that of a column leave a task."""
    def seen(batches):
        import numpy as np
        import pyarrow as pa

        held = {n: np.zeros(0) for n in columns}
        for b in batches:
            for n in columns:
                if len(held[n]) < most:
                    v = b.column(n).drop_null().to_numpy(zero_copy_only=False)
                    held[n] = np.unique(np.concatenate([held[n], np.unique(v)[:most]]))[:most]
        names = [n for n in columns for _ in held[n]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x for n in columns for x in held[n].tolist()], pa.float64())], ["column", "value"])

    few = df.select(*[F.col(n).cast("double").alias(n) for n in columns]).mapInArrow(seen, "column string, value double")
    return few.groupBy("column").agg(F.least(F.count_distinct("value"), F.lit(most)).alias("kinds"))


def outliers_zscore(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Values over ``limit`` deviations become the median; columns with under 5 values are left."""
    st = column_moments(df, columns).join(column_quantiles(df, columns, [0.5], ["median"]), "column")
    st = st.join(some_kinds(df, columns, 5), "column")

    def rule(x, s):
        far = (s["kinds"] >= 5) & (F.abs(div(x - s["mean"], s["std"])) > limit)
        return F.when(far, s["median"]).otherwise(x)

    return _apply(df, st, columns, ["mean", "std", "median", "kinds"], rule)


def outliers_iqr(df: DataFrame, columns: list[str], width: float = 1.5) -> DataFrame:
    st = column_quantiles(df, columns, [0.25, 0.5, 0.75], ["q1", "median", "q3"])

    def rule(x, s):
        iqr = s["q3"] - s["q1"]
        return F.when((x < s["q1"] - width * iqr) | (x > s["q3"] + width * iqr), s["median"]).otherwise(x)

    return _apply(df, st, columns, ["q1", "median", "q3"], rule)


def winsorize(df: DataFrame, columns: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    st = column_quantiles(df, columns, [lo, hi], ["lo", "hi"])
    return _apply(df, st, columns, ["lo", "hi"], lambda x, s: clip(x, s["lo"], s["hi"]))


def forest_pool(df: DataFrame, columns: list[str], key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, x) of the rows that trees grow on: about ``trees * sample`` in all, chosen by MD5 of the key.

    A row is taken if its hash lies below that share of the rows, and belongs to one tree; only of a table smaller than all samples
    does a row stand in several, as many as the samples need."""
    n = df.agg(F.count(F.lit(1))).first()[0] or 1
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    copies = min(trees, max(1, math.ceil(trees * sample / n)))
    rows = df.filter(part(1) / 2.0**32 < trees * sample / n).dropna(subset=columns)
    return rows.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("j"), part(9).alias("t"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).select(
        ((F.col("t") + F.col("j")) % trees).cast("int").alias("tree"), "x")


def _grown(pdf, depth: int, seed: int):
    """The nodes of one tree, numbered as in a heap: column, cut and size. A node's column and cut follow from MD5 of tree and node."""
    import hashlib

    import numpy as np
    import pandas as pd

    tree, data, out = int(pdf["tree"].iloc[0]), np.array(pdf["x"].tolist(), dtype=float), []

    def grow(node: int, level: int, rows) -> None:
        low, high = (f(data[rows], axis=0) for f in (np.min, np.max))
        wide = np.flatnonzero(high > low)
        if level == depth or not len(wide):
            out.append((node, -1, 0.0, len(rows)))
            return
        digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
        c = int(wide[int(digest[8:16], 16) % len(wide)])
        cut = low[c] + int(digest[:8], 16) / 2.0**32 * (high[c] - low[c])
        out.append((node, c, cut, len(rows)))
        right = data[rows, c] >= cut
        for child, own in ((2 * node, rows[~right]), (2 * node + 1, rows[right])):
            if len(own):
                grow(child, level + 1, own)

    grow(1, 0, np.arange(len(data)))
    return pd.DataFrame([(tree, *r) for r in out], columns=["tree", "node", "c", "cut", "size"])


def outliers_forest(df: DataFrame, columns: list[str], key: str, share: float = 0.05, trees: int = 100,
                    sample: int = 256, seed: int = 11) -> DataFrame:
    """Isolation forest: trees grow on samples of about ``sample`` rows in parallel, and every row is scored, once.

    All choices follow from MD5, so a lost task repeats them and SQL can. Rows over the exact (1 - share) quantile of the score get the
    inlier median. A null goes to the right of every cut. The forest, at most ``trees * 2 * sample`` nodes, is broadcast.
    """
    import numpy as np
    import pandas as pd

    depth = max(1, math.ceil(math.log2(sample)))
    pool = forest_pool(df, columns, key, trees, sample, seed)
    nodes = pool.groupBy("tree").applyInPandas(lambda pdf: _grown(pdf, depth, seed), "tree int, node int, c int, cut double, size long").collect()
    forest = {}
    for r in nodes:
        c, cut, size = forest.setdefault(r["tree"], (np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1)), np.zeros(2 ** (depth + 1))))
        c[r["node"]], cut[r["node"]], size[r["node"]] = r["c"], r["cut"], r["size"]
    shared = df.sparkSession.sparkContext.broadcast(list(forest.values()))

    def path_norm(n):
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.array(pdf["x"].tolist(), dtype=float)
            total, rows = np.zeros(len(v)), np.arange(len(v))
            for c, cut, size in shared.value:
                at = np.ones(len(v), dtype=int)
                for _ in range(depth):
                    inner = c[at] >= 0
                    right = ~(v[rows, c[at].clip(0)] < cut[at])
                    at = np.where(inner, 2 * at + right, at)
                total += np.floor(np.log2(at)) + path_norm(size[at])
            mean = np.round(total / max(len(shared.value), 1), 9)
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-mean / path_norm(np.array(float(sample))))})

    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in columns]).alias("x"))
    scored = cut_lineage(rows.mapInPandas(score, f"{key} {key_type}, score double"))
    cut = exact_quantiles(scored, [], "score", [1.0 - share], ["cut"]).scalar()
    flagged = df.join(scored.withColumn("outlier", F.col("score") > cut), key)
    med = column_quantiles(flagged.filter(~F.col("outlier")), columns, [0.5], ["m"])
    return _apply(flagged, med, columns, ["m"], lambda v, s: F.when(F.col("outlier"), s["m"]).otherwise(v))


# --- scaling ----------------------------------------------------------------------


def fit_scaler(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, center, spread): apply as (x - center)/spread; a zero spread leaves the column."""
    if kind in ("robust",):
        q = column_quantiles(df, columns, [0.25, 0.5, 0.75], ["q1", "m", "q3"])
        return q.select("column", F.col("m").alias("center"), (F.col("q3") - F.col("q1")).alias("spread"))
    m = column_moments(df, columns)
    if kind == "standard":
        return m.select("column", F.col("mean").alias("center"), F.col("std_pop").alias("spread"))
    if kind == "minmax":
        return m.select("column", F.col("min").alias("center"), (F.col("max") - F.col("min")).alias("spread"))
    if kind == "decimal":
        top = F.greatest(F.abs("min"), F.abs("max"))
        return m.select("column", F.lit(0.0).alias("center"), F.when(top > 0, F.pow(F.lit(10.0), F.floor(F.log10(top)))).otherwise(0.0).alias("spread"))
    raise ValueError(f"unknown scaler {kind}")


def scale(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    return _apply(df, stats, columns, ["center", "spread"],
                  lambda x, s: F.when(s["spread"] != 0, (x - s["center"]) / s["spread"]).otherwise(x))


def unscale(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    return _apply(df, stats, columns, ["center", "spread"],
                  lambda x, s: F.when(s["spread"] != 0, x * s["spread"] + s["center"]).otherwise(x))


def row_scale(values: Column) -> Column:
    """Standardise an array as its own series (population deviation)."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    sd = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.transform(values, lambda x: F.when(sd > 0, (x - mean) / sd).otherwise(0.0))

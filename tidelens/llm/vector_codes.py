"""Compression of vectors to short codes: a codebook for each part of a vector, nearest entries by intersected bitmasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelens.llm.native import store

PARTS = 4
ENTRIES = 256
SCALE = 1024
LARGEST = 1 << 24  # components of the integer grid end here, so that sums of squares fit
SLAB = 1024  # vectors searched at once


class Masks:
    """The entries of one codebook, sorted along each dimension, with the set of the first k entries there as a bitmask for each k.

    The entries between two coordinates are the difference of two such sets. Entries within a radius of a point are in that range in
    every dimension, so the intersection over the dimensions holds all of them."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        k, width = entries.shape
        words = -(-k // 64)
        bit = np.zeros((k, words), np.uint64)
        bit[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k, dtype=np.uint64) % np.uint64(64))
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        self.first = np.zeros((width, k + 1, words), np.uint64)
        for d in range(width):
            np.bitwise_or.accumulate(bit[self.order[:, d]], axis=0, out=self.first[d, 1:])

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A radius around each point that reaches an entry for certain: the least distance to the next entry along any dimension."""
        least = np.full(len(x), np.iinfo(np.int64).max)
        for d in range(x.shape[1]):
            at = np.minimum(np.searchsorted(self.sorted[:, d], x[:, d]), len(self.entries) - 1)
            least = np.minimum(least, ((x - self.entries[self.order[at, d]]) ** 2).sum(axis=1))
        r = np.sqrt(least.astype(float)).astype(np.int64) + 1
        return r

    def within(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, entry) pairs whose coordinates all differ by at most the point's radius, in order."""
        mask = np.full((len(x), self.first.shape[2]), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - r, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + r, "right")
            mask &= self.first[d, high] ^ self.first[d, low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point (of equally near ones the first) and its squared distance."""
        best, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), SLAB):
            part = x[a:a + SLAB]
            point, entry = self.within(part, self.radius(part))
            gap = part[point] - self.entries[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            least = np.minimum.reduceat(d, np.searchsorted(point, np.arange(len(part))))
            hit = np.flatnonzero(d == least[point])[::-1]
            best[a + point[hit]] = entry[hit]  # the first of the equally near is written last
            distance[a:a + SLAB] = least
        return best, distance


def codebooks_text(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of PARTS * width numbers; shorter ones end with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), PARTS * width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _sums(batches, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each entry: how many parts of the task's vectors it is nearest to, and their sum. One row an entry leaves a task."""
    parts, k, width = books.shape
    total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
    masks = [Masks(b) for b in books]
    for batch in batches:
        x = _grid(batch.column("q"), width)
        for p, m in enumerate(masks):
            own = x[:, p * width:(p + 1) * width]
            best, _ = m.nearest(own)
            np.add.at(total[p], best, own)
            count[p] += np.bincount(best, minlength=k)
    p, e = np.nonzero(count)
    if len(p):
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                                          pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])


def _codes(batches, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    width, masks = books.shape[2], [Masks(b) for b in books]
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)], dtype=object)
    for batch in batches:
        x = _grid(batch.column("q"), width)
        found = [m.nearest(x[:, p * width:(p + 1) * width]) for p, m in enumerate(masks)]
        code = sum((digits[best] for best, _ in found[1:]), digits[found[0][0]])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found), pa.int64())],
                                         ["id", "label", "code", "error"])


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and q: floor(1024 * x) of every component, of the rows whose vector is whole (no null or non-finite component)."""
    x = F.col(vec_col).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    top = F.lit(float(LARGEST))
    q = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * SCALE, top), -top)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.filter(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), q.alias("q"))


def train(q: DataFrame, rounds: int = 4) -> np.ndarray:
    """Codebooks (part, entry, position) of stored integer vectors: starting from the ENTRIES smallest ids, ``rounds`` times all parts
    are assigned and each used entry is moved to the floor of its parts' mean. Entries in the driver are at most PARTS * ENTRIES."""
    size = q.agg(F.max(F.size("q"))).first()[0]
    width = max(-(-(size or 0) // PARTS), 1)
    seeds = q.orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    start = _grid(pa.array([r["q"] for r in seeds], pa.list_(pa.int32())), width)
    books = np.stack([start[:, p * width:(p + 1) * width] for p in range(PARTS)])
    for _ in range(rounds if seeds else 0):
        sums = q.select("q").mapInArrow(lambda it, books=books: _sums(it, books), "part int, entry int, n long, sums array<long>")
        moved = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()
        books = books.copy()
        for r in moved:
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def encode(q: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distance to the entries) of integer vectors."""
    kind = dict(q.dtypes)["label"]
    return q.mapInArrow(lambda it: _codes(it, books), f"id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = 4) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every whole vector.

    Components are floor(1024 * x), ended at 2^24 either side. A vector is cut into 4 equal parts, each with a codebook of up to 256
    entries (fewer if there are fewer vectors). A part's nearest entry is found by masks: along each dimension the entries are sorted
    and the first k are a bitmask; a radius that surely reaches an entry selects a range in each dimension, the intersected masks give
    the candidates, and only their distances are computed, in integers. Of equally near entries the first is taken.

    Each round is one pass over stored integers that returns one row an entry and task. Vectors that are null or hold a null or
    non-finite component are left out; shorter vectors than the longest end with zeros (also where the length is no multiple of 4).
    Null ids come after all others in the start. Repeated ids are coded row by row. Rows without a label are one group in
    ``label_error``. No vectors give no rows.
    """
    q = store(integer_vectors(vectors, id_col, vec_col, label_col))
    books = train(q, rounds)
    found = store(encode(q, books))
    total = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return found.join(total.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

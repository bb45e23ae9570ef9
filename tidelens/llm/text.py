"""Words of Arrow text columns as 64-bit hashes, computed over whole byte buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes hashed at once; longer only if a single word is

_rng = np.random.default_rng(20240611)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done:done + step] = out[:step] * (out[done - 1] * base)
            done += step
    return out


_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if n > PIECE:
        return _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    if len(_up) < n:
        _up, _down = _powers(_BASE, PIECE), _powers(_BASE_INVERSE, PIECE)
    return _up, _down


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_set(spec: bytes) -> np.ndarray:
    """A mask of 256 bytes, true for those in ``spec``."""
    m = np.zeros(256, bool)
    m[np.frombuffer(spec, np.uint8)] = True
    return m


BLANK = byte_set(b" \t\n\x0b\x0c\r")
_identity = np.arange(256, dtype=np.uint8)
LOWER = _identity.copy()
LOWER[65:91] += 32
SHAPE = _identity.copy()  # letter case, digits and signs; runs of one class count once
SHAPE[65:91] = 65
SHAPE[97:123] = 97
SHAPE[48:58] = 48
SHAPE[128:] = 97


@dataclass
class Words:
    hashes: np.ndarray  # uint64, in order
    doc: np.ndarray  # index of the text each word is in


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string()).fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def pieces(raw: np.ndarray, off: np.ndarray, separators: np.ndarray = BLANK) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that cut no word."""
    pos, end = int(off[0]), int(off[-1])
    while pos < end:
        cut = min(pos + PIECE, end)
        if cut < end:
            k = int(np.searchsorted(off, cut, "right")) - 1
            if off[k] > pos:
                cut = int(off[k])
            else:
                gaps = np.flatnonzero(separators[raw[pos:cut]])
                if len(gaps):
                    cut = pos + int(gaps[-1]) + 1
                else:
                    row_end = int(off[k + 1])
                    gaps = np.flatnonzero(separators[raw[cut:row_end]])
                    cut = cut + int(gaps[0]) + 1 if len(gaps) else row_end
        yield pos, cut
        pos = cut


def words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray = BLANK, fold: np.ndarray = LOWER, runs: bool = False) -> Iterator[Words]:
    """Hashes of the words (runs of bytes that are no separators) of all rows, piece by piece and in order.

    Bytes are first mapped by ``fold``; with ``runs`` a run of equal mapped bytes in a word counts as one.
    """
    for a, z in pieces(raw, off, separators):
        b = raw[a:z]
        word = ~separators[b]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        lo, hi = np.searchsorted(off, [a, z], "left")
        edges = off[lo:hi]
        edges = edges[(edges > a) & (edges < z)] - a
        first[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last)
        if not len(start):
            continue
        folded = fold[b]
        if runs:
            keep = word.copy()
            keep[1:] &= (folded[1:] != folded[:-1]) | first[1:]
            rank = np.cumsum(keep)
            start_at, stop_at = rank[start] - 1, rank[stop]
            folded = folded[keep]
        else:
            start_at, stop_at = start, stop + 1
        up, down = _power_tables(len(folded) + 1)
        total = np.empty(len(folded) + 1, np.uint64)
        total[0] = 0
        value = _LETTER[folded]
        value *= up[:len(folded)]
        np.cumsum(value, out=total[1:])
        h = (total[stop_at] - total[start_at]) * down[start_at]
        h ^= (stop_at - start_at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        yield Words(mix64(h), np.searchsorted(off, start + a, "right") - 1)


def all_words(raw: np.ndarray, off: np.ndarray, **how) -> Words:
    found = list(words(raw, off, **how))
    if not found:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Words(np.concatenate([w.hashes for w in found]), np.concatenate([w.doc for w in found]))


def shingles(w: Words, n: int) -> Words:
    """Hashes of ``n`` consecutive words of a text; a text with fewer words, but not none, gives its whole sequence once."""
    if not len(w.hashes):
        return w
    h, doc = w.hashes, w.doc
    count = len(h)
    acc = np.zeros(max(count - n + 1, 0), np.uint64)
    for i in range(n):
        acc = mix64(acc * np.uint64(3) + h[i:count - n + 1 + i]) if len(acc) else acc
    same = doc[:len(acc)] == doc[n - 1:] if len(acc) else np.zeros(0, bool)
    full, full_doc = acc[same], doc[:len(acc)][same]
    ids, at, size = np.unique(doc, return_index=True, return_counts=True)
    short = np.flatnonzero(size < n)
    if not len(short):
        return Words(full, full_doc)
    extra = np.full(len(short), np.uint64(0x5851F42D4C957F2D))
    for i in range(n - 1):
        has = size[short] > i
        extra[has] = mix64(extra[has] * np.uint64(5) + h[at[short[has]] + i])
    return Words(np.concatenate([full, extra]), np.concatenate([full_doc, ids[short]]))


def slices(batch: pa.RecordBatch | pa.Table, column: str, size: int = 8 << 20) -> Iterator:
    """Row slices of a batch with about ``size`` bytes of text each (at least one row)."""
    _, off = buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop

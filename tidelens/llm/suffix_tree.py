"""Language-model scoring with a probabilistic suffix tree over word contexts of variable length."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F

from tidelens.llm import text as T
from tidelens.llm.native import NO_ID, new_folder, store

END = np.uint64(0x0BADC0DE0BADC0DE)  # the token after the last word
SLICE_BYTES = 16 << 20
CODED = "slice long, ids binary, learn binary, ends binary, codes binary, words binary, seen binary, counts binary, learnt long, tokens long"
ASKED = "kind string, shard int, slice long, keys binary, values binary"
TOLD = "kind string, shard int, slice long, values binary"
SHARD_KEYS = 4_000_000  # tokens for each shard: a shard sums what slices ask in memory
APART = 512  # numbers from which byte planes are compressed apart
BUCKET_BITS = 22  # buckets of a shard, in which pairs are counted first: at least one for each token


@dataclass
class Level:
    """The frequent k-grams and what follows them. A k-gram is (number of its first k-1 words, number of its last word)."""

    grams: np.ndarray  # sorted keys: first * F + last; for k = 1 the sorted word hashes
    state: np.ndarray  # per gram: the retained state of its longest retained suffix


@dataclass
class Tree:
    words: np.ndarray  # hashes of the frequent words, sorted
    base: np.ndarray  # their log10 root probabilities
    levels: list[Level] = field(default_factory=list)
    edges: np.ndarray = None  # sorted keys state * F + word
    gain: np.ndarray = None  # per edge: log10(p / root p)
    rest: np.ndarray = None  # per state: log10 of the factor on root probabilities of all other words; state 0 is the root


def planes(a: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress better."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def packed(a: np.ndarray, level: int = 1) -> bytes:
    """Numbers compressed; unless they are few, each byte plane by itself, as planes differ in what they hold."""
    zstd, size = pa.Codec("zstd", compression_level=level), len(a).to_bytes(8, "little")
    if len(a) < APART:
        return size + zstd.compress(planes(a), asbytes=True)
    return size + _joined([zstd.compress(p.tobytes(), asbytes=True) if p.any() else b"" for p in a.view(np.uint8).reshape(len(a), a.itemsize).T])


def unpacked(b: bytes, dtype) -> np.ndarray:
    size, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if size < APART:
        return from_planes(pa.decompress(b[8:], size * width, "zstd", asbytes=True), dtype)
    out = np.zeros((size, width), np.uint8)
    for i, p in enumerate(_parted(b[8:])):
        if p:
            out[:, i] = np.frombuffer(pa.decompress(p, size, "zstd", asbytes=True), np.uint8)
    return out.view(dtype).ravel()


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(b).to_bytes(4, "little") + b for b in parts)


def _parted(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        size = int.from_bytes(b[at:at + 4], "little")
        out.append(b[at + 4:at + 4 + size])
        at += 4 + size
    return out


def _by_length(a: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: their lengths in binary digits, then for each length what follows the first digit."""
    a = a.astype(np.uint32) + np.uint32(1)
    length = np.frexp(a.astype(np.float64))[1].astype(np.uint8)
    rest = a[np.argsort(length, kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(length, minlength=33))])
    return _joined([packed(length, 3), *(packed(rest[cuts[k]:cuts[k + 1]] - np.uint32(1 << (k - 1)), 3) for k in range(1, 33))])


def _from_lengths(b: bytes) -> np.ndarray:
    length, *rest = _parted(b)
    length = unpacked(length, np.uint8)
    out = np.empty(len(length), np.uint32)
    out[np.argsort(length, kind="stable")] = np.concatenate([unpacked(x, np.uint32) + np.uint32((1 << k) - 1) for k, x in enumerate(rest)])
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, one place of each, and where each key is among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], order[new], back


def _encode(batches) -> Iterator[pa.RecordBatch]:
    """Slices of documents as word numbers (most frequent first) with their own dictionary, in order of hashes and so sent as differences,
    its counts, which tell the numbers, and how many of those the learning part leaves out."""
    for batch in batches:
        for part in T.slices(batch, "text", SLICE_BYTES):
            raw, off = T.buffers(part.column("text"))
            w = T.all_words(raw, off)
            per_doc = np.bincount(w.doc, minlength=part.num_rows) + 1
            ends = np.cumsum(per_doc)
            tokens = np.empty(ends[-1], np.uint64)
            tokens[np.arange(len(w.hashes)) + w.doc] = w.hashes
            tokens[ends - 1] = END
            learn = part.column("learn").to_numpy(zero_copy_only=False).astype(np.uint8)
            words, _, code = _distinct(T.mix64(tokens))
            seen = np.bincount(code)
            new = np.empty(len(words), np.uint32)
            new[np.argsort(-seen, kind="stable")] = np.arange(len(words), dtype=np.uint32)
            counts = np.bincount(code[np.repeat(learn, per_doc) > 0], minlength=len(words)).astype(np.uint32)
            code = new[code]
            row = [uuid.uuid4().int & ((1 << 63) - 1), planes(part.column("d").to_numpy()), learn.tobytes(), planes(ends.astype(np.int64)), _by_length(code),
                   planes(np.diff(words, prepend=np.uint64(0))), planes(seen.astype(np.uint32)), planes(seen.astype(np.uint32) - counts), int(counts.sum()), len(code)]
            kinds = [pa.int64()] + [pa.binary()] * 7 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["slice", "ids", "learn", "ends", "codes", "words", "seen", "counts", "learnt", "tokens"])


@dataclass(frozen=True)
class _How:
    shards: int
    depth: int
    contexts: int  # occurrences that make a context
    own: int  # occurrences after a context that make a successor
    weight: float
    gain: float
    n: int = 0
    v: int = 0
    answers: tuple[str, ...] = ()  # folders, by slice
    wide: int = 1 << 32  # numbers of words are smaller
    spaces: tuple[int, ...] = ()  # and so are those of the contexts, level by level

    @property
    def low(self) -> int:
        return min(self.contexts, self.own)

    @property
    def context(self) -> int:
        return max(self.contexts, 1)

    def chance(self, root: np.ndarray) -> np.ndarray:
        """The root's probability of words by the sum of their counts, each with one added."""
        return root / (self.n + self.v + 1)

    def pair(self, k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Keys of pairs by the numbers of both parts: a bijection that spreads them over as few binary digits as there can be pairs,
        moved to the upper end."""
        bits = max((self.spaces[k - 1] * self.wide - 1).bit_length(), 1) if k <= len(self.spaces) else 64
        x, mask, half = context.astype(np.uint64) * np.uint64(self.wide) + word.astype(np.uint64), np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
        for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            x ^= x >> half
            x = (x * np.uint64(odd)) & mask
        return (x ^ (x >> half)) << np.uint64(64 - bits)


def _spread(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys (spread evenly), the keys in it, their place among all shards (equal ranges of keys) in 40 binary
    digits behind the shard, and where the shards begin."""
    order = np.arange(len(keys)) if (keys[1:] >= keys[:-1]).all() else np.argsort(keys)
    keys = keys[order]
    spot = (keys >> np.uint64(24)) * np.uint64(shards)
    return order, keys, spot, np.searchsorted(spot, np.arange(shards + 1, dtype=np.uint64) << np.uint64(40))


def _spread_numbers(numbers: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of numbers (place in the shard * shards + shard) by shard and place, the places in it, and where the shards begin."""
    shard, place = numbers % shards, numbers // shards
    order = np.lexsort((place, shard))
    return order, place[order].astype(np.uint32), np.searchsorted(shard[order], np.arange(shards + 1))


def _asks(kind: str, who: int, keys: np.ndarray, cuts: np.ndarray, values) -> pa.RecordBatch:
    """A row for each shard. Keys ascend in it and are sent as differences."""
    keep = np.flatnonzero(cuts[:-1] < cuts[1:])
    steps = np.diff(keys, prepend=keys[:1])
    steps[cuts[keep]] = keys[cuts[keep]]
    return pa.RecordBatch.from_arrays([
        pa.array([kind] * len(keep), pa.string()), pa.array(keep, pa.int32()), pa.array([who] * len(keep), pa.int64()),
        pa.array([packed(steps[cuts[i]:cuts[i + 1]]) for i in keep], pa.binary()),
        pa.array([values(cuts[i], cuts[i + 1]) for i in keep], pa.binary())], ["kind", "shard", "slice", "keys", "values"])


def _dealt(kind: str, who: int, keys: np.ndarray, values: np.ndarray, shards: int) -> pa.RecordBatch:
    """A slice's keys with values, a row for each shard of the key space; of kind ``f`` only their buckets are sent."""
    order, keys, spot, cuts = _spread(keys, shards)
    if kind[0] == "f":
        keys = ((spot & np.uint64((1 << 40) - 1)) >> np.uint64(40 - BUCKET_BITS)).astype(np.uint32)
    values = values[order]
    return _asks(kind, who, keys, cuts, lambda a, z: packed(values[a:z]))


def _dealt_contexts(kind: str, who: int, numbers: np.ndarray, needs: np.ndarray, tells: np.ndarray, sums: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """A slice's contexts by number: whether it needs their factor, whether it tells sums, and the sums (of all contexts) where it does."""
    order, places, cuts = _spread_numbers(numbers, shards)
    flags, tells = (needs + 2 * tells).astype(np.uint8)[order], tells[order]
    sums = [x[order] for x in sums]
    return _asks(kind, who, places, cuts, lambda a, z: _joined([packed(flags[a:z]), *(packed(x[a:z][tells[a:z]]) for x in sums)]))


def _told(folders: tuple[str, ...], who: int) -> dict[str, list[tuple[int, bytes]]]:
    """kind -> (shard, values) of all answers to one slice."""
    out: dict[str, list] = {}
    for folder in folders:
        fs, base = pafs.FileSystem.from_uri(folder)
        for file in fs.get_file_info(pafs.FileSelector(f"{base}/slice={who}", allow_not_found=True)):
            if file.base_name.endswith(".parquet"):
                with fs.open_input_file(file.path) as f:
                    rows = pq.ParquetFile(f).read()
                for kind, shard, values in zip(*(rows.column(c).to_pylist() for c in ("kind", "shard", "values"))):
                    out.setdefault(kind, []).append((shard, values))
    return out


def _heard(answers: dict, kind: str, keys: np.ndarray, dtype, shards: int) -> np.ndarray:
    """The answers to what ``_dealt`` asked, in the order of ``keys``."""
    out, (order, *_, cuts) = np.zeros(len(keys), dtype), _spread(keys, shards)
    for shard, values in answers.get(kind, ()):
        out[order[cuts[shard]:cuts[shard + 1]]] = unpacked(values, dtype)
    return out


def _heard_numbers(answers: dict, kind: str, keys: np.ndarray, some: np.ndarray, shards: int) -> np.ndarray:
    """Numbers of the keys that are in ``some``, -1 for others."""
    out, (order, *_, cuts) = np.full(len(keys), -1), _spread(keys, shards)
    for shard, values in answers.get(kind, ()):
        at = order[cuts[shard]:cuts[shard + 1]]
        out[at[some[at]]] = np.cumsum(unpacked(values, np.uint32), dtype=np.int64) * shards + shard
    return out


def _heard_contexts(answers: dict, kind: str, numbers: np.ndarray, needs: np.ndarray, total: np.ndarray, how: _How) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are retained, and their factors where they are needed."""
    kept, rest, (order, _, cuts) = np.zeros(len(numbers), bool), np.ones(len(numbers)), _spread_numbers(numbers, how.shards)
    for shard, values in answers.get(kind, ()):
        at, (flags, *factors) = order[cuts[shard]:cuts[shard + 1]], _parted(values)
        kept[at] = unpacked(flags, np.uint8) > 0
        at = at[kept[at] & needs[at]]
        if kind == "c1":
            seen, root = (unpacked(x, np.int64) for x in factors)
            rest[at] = _factor(total[at], seen, how.chance(root), root, how)
        else:
            rest[at] = unpacked(factors[0], np.float64)
    return kept, rest


def _left(total: np.ndarray, seen: np.ndarray, low: np.ndarray, how: _How) -> np.ndarray:
    """What a context leaves to words that are not its own."""
    return np.maximum((np.maximum(total - seen, 0) + how.weight * (1 - low)) / np.maximum(total + how.weight, 1e-300), 1e-12)


def _factor(total: np.ndarray, seen: np.ndarray, low: np.ndarray, root: np.ndarray, how: _How) -> np.ndarray:
    return _left(total, seen, low, how) / np.maximum(1 - how.chance(root), 1e-12)


def _answer(batches, how: _How) -> Iterator[pa.RecordBatch]:
    """Totals over all slices, back to each asker in its order. Words: counts; then the number of words seen (slice -1, in ``shard``).
    Buckets of pairs: 1 if a pair of it can reach ``low``, 2 if it can be a context, else 0. Pairs: twice the count, plus one for a
    single asker of each (0 under ``low``). Words that reach ``low`` (kind l) and contexts (kind i) are numbered in each shard, and so
    named from then on; how many there are is told, too (slice -1). Contexts: whether they are retained, and for those who need it the factor on
    root probabilities of words that are not their own (at the first level as the two whole numbers that give it)."""
    asked: dict[tuple, list] = {}
    for b in batches:
        for r in b.to_pylist():
            keys = unpacked(r["keys"], np.uint32 if r["kind"][0] in "cf" else np.uint64)
            asked.setdefault((r["kind"][0], r["shard"]), []).append((r["kind"], r["slice"], np.cumsum(keys, dtype=keys.dtype), r["values"]))
    row = lambda kind, shard, who, values: pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([shard], pa.int32()), pa.array([who], pa.int64()), pa.array([values], pa.binary())], ["kind", "shard", "slice", "values"])
    for sort, shard in list(asked):
        rows = asked.pop((sort, shard))
        if sort == "c":
            asks = [(k, *(unpacked(x, t) for x, t in zip(_parted(x), _SUMS))) for *_, k, x in rows]
            kept, *factors = _judge(asks, how)
            for (kind, who, k, _), (_, flags, *_) in zip(rows, asks):
                need = k[kept[k] & (flags & 1 > 0)]
                yield row(kind, shard, who, _joined([packed(kept[k].astype(np.uint8)), *(packed(x[need]) for x in factors)]))
            continue
        if sort == "f":
            total = np.bincount(np.concatenate([k for *_, k, _ in rows]), np.concatenate([unpacked(x, np.uint32) for *_, x in rows]), 1 << BUCKET_BITS)
            can = (total >= how.low).astype(np.uint8) + (total >= max(how.contexts, 1))
            for kind, who, k, _ in rows:
                yield row(kind, shard, who, packed(can[k]))
            continue
        keys, totals = _sum_keys([(k, unpacked(x, np.int64)) for *_, k, x in rows])
        free = np.ones(len(keys), bool)
        named = {"l": totals >= how.low, "i": totals >= how.context} if sort == "w" else {"i": totals >= max(how.context, how.low)}
        places = {x: np.cumsum(some) - 1 for x, some in named.items()}
        for x, some in named.items() if rows[0][0] != f"p{how.depth}" else ():
            yield row(x, int(some.sum()), -1, b"")
        for kind, who, k, _ in rows:
            at = np.searchsorted(keys, k)
            for x, some in named.items() if kind != f"p{how.depth}" else ():
                yield row(x + kind, shard, who, packed(np.diff(places[x][at[some[at]]], prepend=0).astype(np.uint32)))
            values = totals[at] if sort == "w" else np.where(totals[at] >= how.low, totals[at] * 2 + free[at], 0)
            free[at] = False
            yield row(kind, shard, who, packed(values))
        if sort == "w":
            yield row("v", int((totals > 0).sum()), -1, b"")


def _sum_keys(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in rows]), np.concatenate([c for _, c in rows], axis=-1)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[..., order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at, axis=-1) if len(at) else counts


_SUMS = (np.uint8, np.int64, np.int64, np.int64, np.float64, np.float64)  # flags, then sums as _judge takes them


def _judge(rows: list[tuple], how: _How) -> tuple[np.ndarray, ...]:
    """Divergence test of contexts against their longest retained suffixes, from the slices' sums over the successors they speak for:
    counts, root counts, gains, and probabilities under the suffix if that is not the root. All who tell know the same total. Which
    contexts are retained, and their factors, or what gives them."""
    size, first = 1 + max(int(k[-1]) for k, *_ in rows), len(rows[0]) < 7
    total, seen, root, change, low = (np.zeros(size, t) for t in _SUMS[1:])
    for k, flags, all_, *told in rows:
        at = k[flags > 1]
        total[at] = all_
        for x, y in zip((seen, root, change, low), told):
            x[at] += y
    if first:
        low = how.chance(root)
    change = change + np.maximum(total - seen, 0) * np.log(_left(total, seen, low, how) / np.maximum(1 - low, 1e-12))
    return (change >= how.gain, seen, root) if first else (change >= how.gain, _factor(total, seen, low, root, how))


def _words(r: dict) -> np.ndarray:
    return np.cumsum(from_planes(r["words"], np.uint64), dtype=np.uint64)


def _before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token: the value of the token before it in its document, or 0."""
    out = np.zeros(len(values), values.dtype)
    out[1:] = values[:-1]
    out[first] = 0
    return out


class _Walk:
    """A coded slice followed level by level, as far as the shards have answered."""

    def __init__(self, r: dict, how: _How) -> None:
        self.r, self.how, self.answers = r, how, _told(how.answers, r["slice"])
        words, self.ends = _words(r), from_planes(r["ends"], np.int64)
        code = np.argsort(-from_planes(r["seen"], np.uint32).astype(np.int64), kind="stable").astype(np.int32)[_from_lengths(r["codes"])]
        count = _heard(self.answers, "w", words, np.int64, how.shards)
        self.words, self.code, self.count = words, code, count[code]
        self.number = _heard_numbers(self.answers, "lw", words, count >= how.low, how.shards)
        self.contexts = _heard_numbers(self.answers, "iw", words, count >= how.context, how.shards)
        self.root = (self.count + 1) / (how.n + how.v + 1)
        self.first = np.concatenate([[0], self.ends[:-1]])

    def go(self, done: int, last: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of ``done`` levels are answered, contexts of one level less, and buckets of one more: asks for the contexts of that
        level, the pairs of the next and the buckets of the one after. With ``last`` all are answered, and ``chance`` is the
        probability of each token.

        A pair can occur ``low`` times only if its context is one, the pair without the context's first word does, and so do the pairs
        of its bucket together: no other is asked. For buckets, both parts are judged by theirs."""
        how, who, chance = self.how, self.r["slice"], self.root.copy()
        size, names, numbers, total, held = len(self.code), self.words, self.contexts, _before(self.count, self.first), self.count
        context = _before(self.code, self.first)  # of each token, the run of words before it by its place in ``names``
        may = np.ones(size, bool)
        may[self.first] = False
        for k in range(1, how.depth + 1):
            at = np.flatnonzero(may)
            keys, one, back = _distinct(T.mix64(names[context[at]] * np.uint64(3) + self.words[self.code[at]]))
            if k > done:
                learn = np.repeat(np.frombuffer(self.r["learn"], np.uint8), np.diff(self.ends, prepend=0))[at] > 0
                counts = np.bincount(back[learn], minlength=len(keys)).astype(np.int64)
            if k > done + 1:
                yield _dealt(f"f{k}", who, keys, np.minimum(counts, max(how.contexts, how.low)).astype(np.uint32), how.shards)
                return
            can = _heard(self.answers, f"f{k}", keys, np.uint8, how.shards)
            live = total >= how.context
            sure = np.flatnonzero((can > 0) & live[at[one]] & (held[at[one]] >= how.low))
            spot = at[one[sure]]
            pairs = how.pair(k, numbers[context[spot]], self.number[self.code[spot]])
            near, gram = np.zeros(size, np.uint8), np.zeros(size, np.uint32)
            near[at], gram[at] = can[back], back
            may = (near >= min(how.low, 1)) & (_before(near, self.first) > 1)
            if k > done:
                yield _dealt(f"p{k}", who, pairs, counts[sure], how.shards)
                names, context = keys, _before(gram, self.first)
                continue
            told = np.zeros(len(keys), np.int64)
            told[sure] = _heard(self.answers, f"p{k}", pairs, np.int64, how.shards)
            deeper = np.full(len(keys), -1)
            if k < how.depth:
                deeper[sure] = _heard_numbers(self.answers, f"ip{k}", pairs, told[sure] >> 1 >= max(how.context, how.low), how.shards)
            held = np.zeros(size, np.int64)
            held[at] = (told >> 1)[back]
            del back, near
            spots = np.flatnonzero(live)
            its = np.full(len(names), -1)
            its[context[spots]] = spots
            mine = np.flatnonzero(its >= 0)
            contexts, place = numbers[mine], np.empty(len(names), np.int64)
            place[mine] = np.arange(len(mine))
            needs = np.bincount(place[context[spots]], held[spots] < how.own, len(mine)) > 0
            if k == done and not last:
                t = at[one[((told & 1) > 0) & (told >> 1 >= how.own)]]
                c, n, low = place[context[t]], held[t], chance[t]
                p = (n + how.weight * low) / (total[t] + how.weight)
                sums = [np.bincount(c, weights=x, minlength=len(contexts)) for x in (n, self.count[t] + 1, n * np.log(p / low), low)[:3 + (k > 1)]]
                sums = [total[its[mine]], *(np.rint(x).astype(np.int64) for x in sums[:2]), *sums[2:]]
                yield _dealt_contexts(f"c{k}", who, contexts, needs, np.bincount(c, minlength=len(contexts)) > 0, sums, how.shards)
            else:
                kept, rest = _heard_contexts(self.answers, f"c{k}", contexts, needs, total[its[mine]], how)
                c = place[context[spots]]
                t, rest = spots[kept[c]], rest[c[kept[c]]]
                chance[t] = np.where(held[t] >= how.own, (held[t] + how.weight * chance[t]) / (total[t] + how.weight), rest * self.root[t])
            names, numbers, context, total = keys, deeper, _before(gram, self.first), _before(held, self.first)
        self.chance = chance


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _next_asks(batches, how: _How, done: int) -> Iterator[pa.RecordBatch]:
    """What a slice asks of the shards; first of all (``done`` -1) its words with their counts, too."""
    for r in _rows(batches):
        if done < 0:
            yield _dealt("w", r["slice"], _words(r), (from_planes(r["seen"], np.uint32) - from_planes(r["counts"], np.uint32)).astype(np.int64), how.shards)
        yield from _Walk(r, how).go(done, False)


def _score(batches, how: _How) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        w = _Walk(r, how)
        for _ in w.go(how.depth, True):
            pass
        total = lambda x: np.add.reduceat(x, w.first)
        yield pa.RecordBatch.from_arrays([
            pa.array(from_planes(r["ids"], np.int64)), pa.array(np.diff(w.ends, prepend=0)), pa.array(total((w.count > 0).astype(np.int64))),
            pa.array(total(np.log10(w.root))), pa.array(total(np.log10(w.chance)))], ["d", "n_tokens", "n_known", "base_score", "score"])


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class _Builder:
    """The model of a small table in one place, level by level; tests compare with it. Queries never build it."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int, weight: float, gain: float) -> None:
        self.tree, self.weight, self.gain, self.size = Tree(words, np.log10((counts + 1) / (n + v + 1))), weight, gain, len(words)
        self.root = 10 ** self.tree.base
        self.rest, self.edges, self.p = [1.0], np.zeros(0, np.int64), np.zeros(0)
        self.counts, self.suffix = counts, np.zeros(len(words), np.int64)
        self.grams = words

    def probability(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = _lookup(self.edges, state * self.size + word)
        other = np.asarray(self.rest)[state] * self.root[word]
        return np.where(at >= 0, self.p[at], other) if len(self.edges) else other

    def add(self, keys: np.ndarray, counts: np.ndarray, least: int) -> None:
        """``keys``: (gram of this level, next word) with ``counts``; then the next level's grams are those counted ``least`` times."""
        keys = keys.astype(np.int64)
        first, last = keys // max(self.size, 1), keys % max(self.size, 1)
        n = len(self.counts)
        parent = self.suffix_state()
        lower = self.probability(parent[first], last)
        total = self.counts.astype(float)
        p = (counts + self.weight * lower) / (total[first] + self.weight)
        seen, mass = np.bincount(first, weights=counts, minlength=n), np.bincount(first, weights=p, minlength=n)
        root_mass, low_mass = np.bincount(first, weights=self.root[last], minlength=n), np.bincount(first, weights=lower, minlength=n)
        left = np.maximum(total - seen, 0)
        change = np.bincount(first, weights=counts * np.log(p / lower), minlength=n) + left * np.log(np.maximum(1 - mass, 1e-12) / np.maximum(1 - low_mass, 1e-12))
        kept = change >= self.gain
        state = parent.copy()
        state[kept] = len(self.rest) + np.arange(kept.sum())
        self.tree.levels.append(Level(self.grams, state))
        self.rest = np.concatenate([self.rest, (np.maximum(1 - mass, 1e-12) / np.maximum(1 - root_mass, 1e-12))[kept]])
        live = kept[first]
        edges, p_new = np.concatenate([self.edges, state[first[live]] * self.size + last[live]]), np.concatenate([self.p, p[live]])
        order = np.argsort(edges)
        self.edges, self.p = edges[order], p_new[order]
        often = counts >= least
        ended = last == _lookup(self.tree.words, np.array([END]))[0]
        often &= ~ended
        upper = self.suffix[first[often]]  # suffix of the first part, one level down; then with the last word on this level
        if len(self.tree.levels) == 1:
            self.suffix = last[often]
        else:
            self.suffix = _lookup(self.grams, upper * self.size + last[often])
        self.grams, self.counts = keys[often], counts[often]

    def suffix_state(self) -> np.ndarray:
        return self.tree.levels[-1].state[self.suffix] if self.tree.levels else np.zeros(len(self.counts), np.int64)

    def done(self) -> Tree:
        t = self.tree
        t.edges, t.rest = self.edges, np.log10(self.rest)
        t.gain = np.log10(self.p) - t.base[self.edges % max(self.size, 1)]
        return t


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, context_count: int = 50, next_count: int = 4,
                weight: float = 30.0, gain: float = 6.0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; the model learns from rows where ``learn`` is true.

    Tokens are words between ASCII blanks, A-Z lower-cased, and one end. The root gives (c + 1) / (N + V + 1). A context is a run of up
    to ``depth`` words seen at least ``context_count`` times; any words seen ``next_count`` times after it, however rare elsewhere, are
    its own, smoothed with ``weight`` counts of its longest retained suffix, and all other words share what is left in proportion to
    the root: probabilities of a state sum to one. It is retained if it explains what follows it better than that suffix by ``gain``
    nats. A token is scored by the longest retained suffix of the words before it in its text.

    Both counts are the same at any size, and the model grows with the input; it is never in one place. Slices of documents are coded
    once into the shared folder. Their words, then level by level their distinct (context, next word) pairs and contexts, go to shards
    by hash, are summed there, and the answers are written by slice. Pairs are counted by short hashes first, a byte or two each;
    only those whose short hash is frequent enough are sent in full and counted exactly. A pair's part of its context's divergence test is told by one
    of the slices that hold it. There are as many shards as the volume needs.

    Null text is empty and has the end alone; a null ``learn`` is false; with nothing to learn from, every score is that of the root
    with N = V = 0. Rows sharing an id are scored row by row.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    coded = store(base.mapInArrow(_encode, CODED), "zstd")
    n, tokens = (x or 0 for x in coded.agg(F.sum("learnt"), F.sum("tokens")).first())
    how = _How(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // SHARD_KEYS + 1), depth, context_count, next_count, weight, gain, n)

    def answered(asks: DataFrame, how: _How) -> _How:
        """Answers are written by slice, where the scan of the slices finds them: neither is sent again in later rounds."""
        folder = new_folder(docs)
        folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        asks.repartition(how.shards, "shard").mapInArrow(lambda it: _answer(it, how), TOLD).repartition(how.shards, "slice").write.partitionBy("slice").option("compression", "zstd").parquet(folder)
        told = spark.read.schema(TOLD).parquet(folder).filter("slice = -1").groupBy("kind").agg(F.sum("shard"), F.max("shard")).collect()
        return replace(how, answers=(*how.answers, folder), **numbered(how, {kind: x for kind, *x in told}))

    def numbered(how: _How, told: dict) -> dict:
        more = {"v": told["v"][0], "wide": max(told["l"][1], 1) * how.shards} if "v" in told else {}
        return more | ({"spaces": (*how.spaces, max(told["i"][1], 1) * how.shards)} if "i" in told else {})

    how = answered(coded.select("slice", "learn", "ends", "codes", "words", "seen", "counts").mapInArrow(lambda it, how=how: _next_asks(it, how, -1), ASKED), how)
    for done in range(depth + 1 if n else 0):
        how = answered(coded.select("slice", "learn", "ends", "codes", "words", "seen").mapInArrow(lambda it, how=how, done=done: _next_asks(it, how, done), ASKED), how)
    how = how if n else replace(how, depth=0)
    scored = coded.select("slice", "ids", "ends", "codes", "words", "seen").mapInArrow(lambda it: _score(it, how), "d long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

"""Near-duplicate texts by Jaccard similarity of word shingles: bounds by token unions, groups of similar documents, exact counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidelens.functions.sieve import sieve
from tidelens.llm import text as T
from tidelens.llm.components import Forest, components, spanning
from tidelens.llm.native import NO_ID, store

GROUP_SHINGLES = 200_000  # shingles of a group of similar documents, about
SLICE_BYTES = 3 << 20  # text whose sets a task holds at once
SHARD_SHINGLES = 2_000_000  # shingles whose part keys meet in one shard, about


class Scheme:
    """How shingle sets are cut into parts such that two similar sets have one part in common.

    Sets with a Jaccard similarity of at least num / den differ in at most (den - num) / (den + num) of the sum of their sizes.
    Sizes are cut into classes; a class's sets, and those that can be similar to them but are in the next class, are cut by hash
    into more parts than they can differ in, so one of the non-empty parts is the same in both.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        low, edges, step = 1, [], Fraction(den, num) ** 2
        while low < 1 << 40:
            edges.append(low)
            low = max(int(low * step), int(low * den / num) + 2)
        self.low = np.array(edges, np.int64)
        top = np.append(self.low[1:], np.int64(1 << 40)) - 1
        self.differ = (den - num) * (top + top * den // num) // (den + num)
        self.parts = self.differ + 1 + self.differ // 6 + np.minimum(self.differ, 2)

    def instances(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, class) of the class itself and of the class before, where a smaller partner can be."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        yield np.arange(len(sizes)), own
        reach = (own > 0) & (sizes * self.num <= (self.low[own] - 1) * self.den)
        yield np.flatnonzero(reach), own[reach] - 1


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) pairs without repetition, sorted by row and shingle."""
    raw, off = T.buffers(column)
    s = T.shingles(T.all_words(raw, off), n)
    order = np.lexsort((s.hashes, s.doc))
    row, h = s.doc[order], s.hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _sums(at: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Order-free 64-bit sums of the hashes at each of ``n`` places."""
    lo = np.bincount(at, weights=(h & np.uint64(0xFFFFFFFF)).astype(float), minlength=n).astype(np.uint64)
    hi = np.bincount(at, weights=(h >> np.uint64(32)).astype(float), minlength=n).astype(np.uint64)
    return lo + (hi << np.uint64(32))


def content_keys(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the size of its set and two 64-bit keys of its content."""
    size = np.bincount(row, minlength=n_rows)
    return size, T.mix64(_sums(row, T.mix64(h), n_rows) + size.astype(np.uint64)), T.mix64(_sums(row, T.mix64(h ^ np.uint64(0xA5A5)), n_rows))


def part_keys(row: np.ndarray, h: np.ndarray, size: np.ndarray, scheme: Scheme, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every non-empty part of each set. A set with too few non-empty parts also gets its class's common key."""
    rows, keys = [], []
    mixed = T.mix64(h + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    first = np.searchsorted(row, np.arange(len(size) + 1))
    for who, cls in scheme.instances(size):
        live = (size[who] > 0) & (scheme.differ[cls] > 0)
        who, cls = who[live], cls[live]
        if not len(who):
            continue
        base = np.zeros(len(who) + 1, np.int64)
        np.cumsum(scheme.parts[cls], out=base[1:])
        count = size[who]
        owner = np.repeat(np.arange(len(who)), count)
        token = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[who], count)
        m = scheme.parts[cls][owner].astype(np.uint64)
        at = base[owner] + ((mixed[token] >> np.uint64(20)) % m).astype(np.int64)
        filled = np.bincount(at, minlength=base[-1]) > 0
        total = _sums(at, h[token], int(base[-1]))
        of = np.repeat(np.arange(len(who)), scheme.parts[cls])
        part = np.arange(base[-1]) - base[of]
        salt = T.mix64((cls[of].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64))
        rows.append(who[of[filled]])
        keys.append(T.mix64(total[filled] ^ salt[filled]))
        short = np.bincount(of[filled], minlength=len(who)) <= scheme.differ[cls]
        rows.append(who[short])
        keys.append(T.mix64(cls[short].astype(np.uint64) ^ np.uint64(0xDEADBEEFCAFE)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profiles(batches, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch, "text", SLICE_BYTES):
            row, h = shingle_sets(part.column("text"), n)
            size, k, k2 = content_keys(row, h, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(size, pa.int64()), pa.array(_signed(k)), pa.array(_signed(k2))], ["d", "n", "k", "k2"])


def _squeeze(counts: np.ndarray) -> bytes:
    """Small counts, most of them 0 or 1 where there are many shards."""
    wide = bool((counts > 255).any())
    return zlib.compress(bytes([wide]) + counts.astype("<u4" if wide else "u1").tobytes(), 1)


def _spread(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, "<u4" if raw[0] else "u1", offset=1).astype(np.int64)


def _token_rows(batches, n: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Per slice of texts and shard of the shingle space one row: how many shingles each text has there, and 24 bits of these. Texts are
    named by their place in the slice; one more row of the slice has their content keys.

    Equal texts of a slice count once. Bytes of a shingle are the same for any number of shards."""
    task, seq = TaskContext.get(), 0
    base = (task.partitionId() if task else 0) << 32
    for batch in batches:
        for part in T.slices(batch, "text", SLICE_BYTES):
            row, h = shingle_sets(part.column("text"), n)
            size, k, _ = content_keys(row, h, part.num_rows)
            first = np.zeros(part.num_rows, bool)
            first[np.unique(k, return_index=True)[1]] = True
            first &= size > 0
            live = first[row]
            place = np.cumsum(first) - 1
            row, h = place[row[live]], T.mix64(h[live])
            if not len(row):
                continue
            shard = ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")  # rows stay in order
            row, h, cuts = row[order], h[order].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3], np.searchsorted(shard[order], np.arange(shards + 1))
            out = [(seq % shards, base + seq, None, k[first].tobytes())]
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                out.append((i, base + seq, _squeeze(np.bincount(row[cuts[i]:cuts[i + 1]], minlength=place[-1] + 1)), h[cuts[i]:cuts[i + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "slice", "counts", "tokens"])
            seq += 1


def _shared(batches, buckets: int) -> Iterator[pa.RecordBatch]:
    """How many of a text's shingles in the shards of one partition are in another text too: summed by text over the shards, and one
    row for each bucket of slices, with the counts of their texts, and with the content keys that were here."""
    held, names = {}, {}
    for batch in batches:
        for i, who, c, t in zip(*(batch.column(x).to_pylist() for x in ("shard", "slice", "counts", "tokens"))):
            if c is None:
                names[who] = t
            else:
                held.setdefault(i, []).append((who, c, t))
    sums = {}
    for i in sorted(held):
        rows = held.pop(i)
        t = np.zeros((sum(len(x[2]) for x in rows) // 3, 4), np.uint8)
        t[:, :3] = np.frombuffer(b"".join(x[2] for x in rows), np.uint8).reshape(-1, 3)
        t = t.view("<u4")[:, 0]
        order = np.argsort(t, kind="stable")
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[order[1:]] == t[order[:-1]]
        both = np.zeros(len(t), bool)
        both[order] = same[1:] | same[:-1]
        total, at = np.concatenate([[0], np.cumsum(both)]), 0
        for who, c, x in rows:
            ends = at + np.cumsum(_spread(c))
            m = np.diff(total[ends], prepend=total[at])
            at = int(ends[-1])
            sums[who] = sums[who] + m if who in sums else m
    by = {}
    for who in sorted({*sums, *names}):
        if who in names or sums[who].any():
            by.setdefault(int(T.mix64(np.array([who], np.uint64))[0] >> np.uint64(33)) % buckets, []).append(who)
    for bucket, own in by.items():
        counts = [_squeeze(sums[who]) if who in sums else b"" for who in own]
        keys = [names.get(who, b"") for who in own]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.list_(t)) for x, t in ((own, pa.int64()), (keys, pa.binary()), (counts, pa.binary())))], ["bucket", "slices", "keys", "counts"])


def _added(batches) -> Iterator[pa.RecordBatch]:
    """(k, m) of the texts of one partition's buckets that share anything: the counts of all shards added up, a row a text of a slice."""
    sums, names = {}, {}
    for batch in batches:
        for slices, keys, counts in zip(*(batch.column(x).to_pylist() for x in ("slices", "keys", "counts"))):
            for who, k, c in zip(slices, keys, counts):
                if k:
                    names[who] = np.frombuffer(k, np.uint64)
                if c:
                    m = _spread(c)
                    sums[who] = sums[who] + m if who in sums else m
    for who, m in sums.items():
        some = m > 0
        yield pa.RecordBatch.from_arrays([pa.array(_signed(names[who][some])), pa.array(m[some])], ["k", "m"])


def _dealt(key: np.ndarray, node: np.ndarray, shards: int) -> pa.RecordBatch:
    shard = ((key >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((key, shard))
    key, node, cuts = key[order], node[order], np.searchsorted(shard[order], np.arange(shards + 1))
    keep = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
    return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([key[cuts[i]:cuts[i + 1]].tobytes() for i in keep], pa.binary()),
                                       pa.array([node[cuts[i]:cuts[i + 1]].tobytes() for i in keep], pa.binary())], ["shard", "keys", "nodes"])


def _part_rows(batches, scheme: Scheme, shards: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per batch and shard of the key space one row of packed (part key, content key) pairs of stored sets, within their families."""
    for batch in batches:
        size = batch.column("n").to_numpy()
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]) if batch.num_rows else np.zeros(0, np.uint64)
        who, key = part_keys(np.repeat(np.arange(batch.num_rows), size), h, size, scheme, seed)
        family = T.mix64(batch.column("family").to_numpy().view(np.uint64))
        yield _dealt(T.mix64(key ^ family[who]), batch.column("k").to_numpy()[who].view(np.uint64), shards)


def _meet(batches) -> Iterator[pa.RecordBatch]:
    """Edges that connect the texts sharing a part key, over the rows of one partition."""
    keys, nodes = [], []
    for batch in batches:
        for x, y in zip(batch.column("keys").to_pylist(), batch.column("nodes").to_pylist()):
            keys.append(np.frombuffer(x, np.uint64))
            nodes.append(np.frombuffer(y, np.int64))
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    shared = same[1:] | same[:-1]
    key, node = key[shared], node[shared]
    if not len(key):
        return
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    head = node[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    other = head != node
    pair = np.unique(np.stack([head[other], node[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    u, v = spanning(pair[:, 0], pair[:, 1])
    for a in range(0, len(u), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[a:a + 50_000]), pa.array(v[a:a + 50_000])], ["u", "v"])


def _sets(batches, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch, "text", SLICE_BYTES):
            row, h = shingle_sets(part.column("text"), n)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            packed = [h[cuts[i]:cuts[i + 1]].tobytes() for i in range(part.num_rows)]
            k = _signed(content_keys(row, h, part.num_rows)[1])
            own = pa.array(k == part.column("k").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("family", "k", "d", "n")] + [pa.array(packed, pa.binary())], ["family", "k", "d", "n", "shingles"]).filter(own)


def _gather(key, pdf):
    """One row of the token-group matrix: a group's documents, their sets, and the union of these."""
    pdf = pdf.sort_values("d").drop_duplicates("k")
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["shingles"]])
    union = np.unique(tokens)
    return pd.DataFrame({"grp": [key[0]], "ids": [pdf["d"].to_numpy(np.int64).tobytes()], "sizes": [pdf["n"].to_numpy(np.int64).tobytes()],
                         "members": [np.searchsorted(union, tokens).astype(np.uint32).tobytes()], "tokens": [union.tobytes()]})


def _open(pdf_iter, num, den, own):
    """Links inside groups (``own``) or between the documents of two groups, reduced to a spanning forest of each pair of groups."""
    for pdf in pdf_iter:
        out = []
        if own:
            pdf = pd.DataFrame({f"{x}_{c}": pdf[c] for x in "ab" for c in ("ids", "sizes", "members", "tokens")})
        for r in pdf.itertuples(index=False):
            a_ids, b_ids = np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.b_ids, np.int64)
            a_size, b_size = np.frombuffer(r.a_sizes, np.int64), np.frombuffer(r.b_sizes, np.int64)
            a_union, b_union = np.frombuffer(r.a_tokens, np.uint64), np.frombuffer(r.b_tokens, np.uint64)
            a_tok, b_tok = np.frombuffer(r.a_members, np.uint32), np.frombuffer(r.b_members, np.uint32)
            place = np.searchsorted(b_union, a_union)
            place[place == len(b_union)] = 0
            hit = b_union[place] == a_union
            cuts = np.concatenate([[0], np.cumsum(a_size)])
            inside = np.add.reduceat(hit[a_tok].astype(np.int64), cuts[:-1])
            # the overlap with the group's union bounds that with each of its documents: at least num / den of the query is needed
            able = (den * inside >= num * a_size) & (a_size * num <= b_size.max() * den) & (b_size.min() * num <= a_size * den)
            owner = np.repeat(np.arange(len(b_ids)), b_size)
            order = np.argsort(b_tok, kind="stable")
            posting, start = owner[order], np.searchsorted(b_tok[order], np.arange(len(b_union) + 1))
            forest = Forest(len(a_ids) + len(b_ids))
            for q in np.flatnonzero(able):
                t = place[a_tok[cuts[q]:cuts[q + 1]]][hit[a_tok[cuts[q]:cuts[q + 1]]]]
                length = start[t + 1] - start[t]
                at = np.repeat(start[t] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                common = np.bincount(posting[at], minlength=len(b_ids))
                like = np.flatnonzero(den * common >= num * (a_size[q] + b_size - common))
                for j in like.tolist():
                    i = j if own else len(a_ids) + j
                    if i != q and forest.join(int(q), i):
                        out.append((a_ids[q], b_ids[j]))
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100,
                    shards: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id linked directly or through others) of every row of ``docs``.

    Two texts are linked when their sets of ``n``-word shingles (words: ASCII A-Z lower-cased, between ASCII blanks; a text of fewer
    words is one shingle) have ``den * |intersection| >= num * |union|``. Texts without words are linked with nothing and their own
    component. Rows with equal sets are one class from the start, so copies are compared once and joined back by class.

    Steps: (1) 32-bit forms of all shingles meet by shard; a text stays only if the shingles it shares with any other text reach num / den
    of its own, as its overlap with the union of the others bounds that with each of them. Texts that merely share passages end here,
    before anything of them is compared. (2) The sets left are cut into parts by hash such that similar sets share a part; packed part
    keys meet by shard, and the texts they connect form families - every link is inside one. (3) A family is dealt into groups of about
    GROUP_SHINGLES shingles, each stored with the union of its tokens. For pairs of groups of a family with fitting sizes, a document's
    overlap with the other group's union bounds its overlap with each document there; only documents that pass are counted exactly.
    (4) Components of the links. Nothing is capped: a large family makes more groups, not larger ones.

    Null text is empty; a null id counts as the smallest; rows sharing an id are separate rows that share its component if equal in
    text (a different text under the same id links through the id). Shingles are 64-bit hashes.
    """
    scheme = Scheme(num, den)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text_col).alias("text"))
    prof = store(base.mapInArrow(lambda it: _profiles(it, n), "d long, n long, k long, k2 long"))
    total = prof.agg(F.sum("n")).first()[0] or 0
    shards = shards or max(8, total // SHARD_SHINGLES)
    # a text can only be similar to others if enough of its shingles are in others: the union of all other texts bounds every one of them
    # as many shards as the session deals to, more only if these grow large; counts go back to the texts' slices, packed and summed by task
    classes = prof.filter("n > 0").groupBy("k", "k2", "n").agg(F.min("d").alias("lead"))
    led = store(prof.filter("n > 0").join(classes, ["k", "k2", "n"]).select("d", "n", "k", "lead"))
    # a copy adds nothing: only what a sieve of their ids lets through is joined with them, the other texts stay where they are
    copies = led.groupBy("d").agg(F.bool_or(F.col("lead") == F.col("d")).alias("leads")).filter("NOT leads").select("d")
    maybe = sieve(copies)(F.col("d"))
    rest = base.filter(maybe).join(copies.hint("merge"), "d", "left_anti").sortWithinPartitions("d", "text")
    deal = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokens = base.filter(~maybe).unionByName(rest).select("text").mapInArrow(lambda it: _token_rows(it, n, deal), "shard int, slice long, counts binary, tokens binary")
    counted = tokens.repartition(deal, "shard").mapInArrow(lambda it: _shared(it, deal), "bucket int, slices array<long>, keys array<binary>, counts array<binary>")
    shared = counted.repartition(deal, "bucket").select("slices", "keys", "counts").mapInArrow(_added, "k long, m long").groupBy("k").agg(F.max("m").alias("m"))
    members = led.filter("d = lead").distinct().join(shared, "k").filter(F.col("m") * den >= F.col("n") * num).select("d", "n", "k", F.lit(0).cast("long").alias("family"))
    members = store(members)
    found = base.filter(sieve(members.select("d"))(F.col("d"))).join(members.hint("merge"), "d").select("family", "k", "d", "n", "text")
    sets = store(found.mapInArrow(lambda it: _sets(it, n), "family long, k long, d long, n long, shingles binary"), "uncompressed")
    parts = sets.mapInArrow(lambda it: _part_rows(it, scheme, shards, 1), "shard int, keys binary, nodes binary")
    closer = components(parts.repartition(shards, "shard").select("keys", "nodes").mapInArrow(_meet, "u long, v long"))
    kept = sets.join(closer.select(F.col("node").alias("k"), F.col("root").alias("home")), "k")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    homes = store(kept.select("k", "n", "home", step.alias("step")))
    share = homes.groupBy("home", "step").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("long").alias("deals"))
    dealt = homes.join(share, ["home", "step"]).select("k", "n", "home", F.xxhash64("home", "step", F.pmod(F.xxhash64("k"), "deals")).alias("grp")).distinct()
    dealt = store(dealt)
    matrix = store(sets.join(dealt.select("k", "grp").hint("merge"), "k").select("grp", "k", "d", "n", "shingles").groupBy("grp").applyInPandas(
        _gather, "grp long, ids binary, sizes binary, members binary, tokens binary"))
    inner = matrix.select("ids", "sizes", "members", "tokens").mapInPandas(lambda it: _open(it, num, den, True), "u long, v long")
    facts = dealt.groupBy("home", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a, b = (facts.select("home", *[F.col(c).alias(f"{x}_{c}") for c in ("grp", "lo", "hi")]) for x in "ab")
    pairs = a.join(b, "home").filter(F.col("a_grp") < F.col("b_grp")).filter(
        (F.col("a_lo") * num <= F.col("b_hi") * den) & (F.col("b_lo") * num <= F.col("a_hi") * den)).select(F.col("a_grp").alias("a"), F.col("b_grp").alias("b"))
    pairs = store(pairs)
    left, right = (matrix.select(F.col("grp").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("ids", "sizes", "members", "tokens")]) for x in "ab")
    outer = pairs.join(left, "a").join(right, "b").drop("a", "b").mapInPandas(lambda it: _open(it, num, den, False), "u long, v long")
    links = inner.union(outer)
    roots = components(links)
    found = led.join(roots, led["lead"] == roots["node"], "left").select("d", "n", F.coalesce("root", "lead").alias("c"))
    out = found.unionByName(prof.filter("n = 0").select("d", "n", F.col("d").alias("c")))
    restore = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(restore("d").alias("doc_id"), F.col("n").alias("n_shingles"), restore("c").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that with the smallest id, all columns kept.

    Of several rows with this id one stays. A row without an id has the smallest and always stays; so do texts without words."""
    found = near_duplicates(docs, id_col, text_col, **how).filter("doc_id IS NOT NULL AND (component_id IS NULL OR doc_id <> component_id)")
    gone = store(found.select(F.col("doc_id").alias("__keep_one_id")).distinct())
    ids = docs.select(F.col(id_col).cast("long").alias("__keep_one_id"))
    again = ids.filter("__keep_one_id IS NOT NULL").groupBy("__keep_one_id").agg(F.count("*").alias("n")).filter("n > 1").select("__keep_one_id")
    # only rows whose id is gone or stands on several rows, and the few others that pass the sieve with them, are joined and numbered
    named = docs.withColumn("__keep_one_id", F.col(id_col).cast("long"))
    close = F.coalesce(sieve(gone.unionByName(again))(F.col("__keep_one_id")) & F.col("__keep_one_id").isNotNull(), F.lit(False))
    kept = named.filter(close).join(gone.hint("merge"), "__keep_one_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("__keep_one_id").orderBy(F.xxhash64(text_col)))
    with_id = kept.withColumn("__keep_one_place", place).filter("__keep_one_place = 1")
    return with_id.select(*docs.columns).unionByName(named.filter(~close).select(*docs.columns))

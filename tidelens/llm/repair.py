"""Structure repair of conversations: cheapest edits by iterative-deepening A*, in segments that are searched on their own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from tidelens.llm.native import BLANKS, NO_ID, store

SEGMENT = 16  # rows searched at once
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row kept is
INF = 1 << 40
AT_END = (0, 10, 5, 0)  # inserts that end a conversation from each state: none, user and assistant, assistant, none
CHEAPEST = {"b": 2, "p": 2}  # rows that must go: blank, repeated

LEAF = "conv long, at long, codes string"
PATHS = LEAF + ", paths array<string>, exits array<int>, total long"
SUMMARY = ("conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
TURNS = "conv long, position long, edit string, role string, text string"


def lower_bounds(codes: str) -> list[int]:
    """At each place, what the rows from there on cost at least: two for each faulty row, one for each of the disjoint pairs of sound
    neighbours that may not follow each other (rows that must go do not part them)."""
    out, free = [0] * (len(codes) + 1), ""
    for i in range(len(codes) - 1, -1, -1):
        x = codes[i]
        out[i] = out[i + 1] + (2 if x in CHEAPEST or x.isupper() else 0)
        if x in CHEAPEST:
            continue
        if x.isupper():
            free = ""
        elif free and x + free not in ("su", "ua", "au"):
            out[i], free = out[i] + 1, ""
        else:
            free = x
    return out


class Search:
    """Edits of one segment. A row is a letter: s, u, a or x (any other initial), upper case if truncated, b or p if it must go.

    ``need`` is the table of failed states: what is proven to be needed from a row and state to the end of the segment."""

    def __init__(self, codes: str, ends: tuple[int, ...]) -> None:
        self.codes, self.ends, self.least = codes, ends, lower_bounds(codes)
        self.need: dict[tuple[int, int], int] = {}
        self.rest = min(ends)

    def bound(self, at: int, state: int) -> int:
        if at == len(self.codes):
            return self.ends[state]
        return self.need.get((at, state), self.least[at] + self.rest)

    def edits(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(initial, cost, next row, next state) in ASCII order."""
        x = self.codes[at]
        follows = ASSISTANT if state == USER else USER
        yield "D", 2, at + 1, state
        yield "I", 5, at, follows
        if x in CHEAPEST:
            return
        late, role = 5 if x.isupper() else 0, x.lower()
        if role == "s" and state == START:
            yield "K", late, at + 1, SYSTEM
        elif role == "ua"[follows == ASSISTANT]:
            yield "K", late, at + 1, follows
        yield "R", 1 + late, at + 1, follows

    def first(self, at: int, state: int, budget: int) -> str | None:
        """The first path in ASCII order that costs at most ``budget``."""
        if self.bound(at, state) > budget:
            return None
        if at == len(self.codes):
            return ""
        lack = INF
        for initial, cost, then, into in self.edits(at, state):
            if cost + self.bound(then, into) <= budget:
                path = self.first(then, into, budget - cost)
                if path is not None:
                    return initial + path
            lack = min(lack, cost + self.bound(then, into))
        self.need[at, state] = max(lack, self.bound(at, state))
        return None

    def cheapest(self, state: int) -> tuple[int, str] | None:
        """(cost, path) of the cheapest path, the first in ASCII order; None if no path leads to an allowed end."""
        most = 2 * len(self.codes) + 15 + max((e for e in self.ends if e < INF), default=-INF)
        while (budget := self.bound(0, state)) <= most:
            path = self.first(0, state, budget)
            if path is not None:
                return budget, path
        return None


@lru_cache(100_000)
def transfer(codes: str) -> tuple[int, ...]:
    """Cheapest cost from each state before the segment to each state after it, row by row of the 4 by 4 table."""
    out = []
    for a in range(4):
        for z in range(4):
            found = Search(codes, tuple(0 if q == z else INF for q in range(4))).cheapest(a)
            out.append(found[0] if found else INF)
    return tuple(out)


@lru_cache(100_000)
def chosen(codes: str, ends: tuple[int, ...], first: bool) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """Costs, paths and states after the segment, by the state before it (only that of the start for the ``first`` of a conversation)."""
    cost, paths, exits = [INF] * 4, [""] * 4, [START] * 4
    search = Search(codes, ends)
    for q in (START,) if first else range(4):
        found = search.cheapest(q)
        if found:
            cost[q], paths[q] = found
            exits[q] = follow(paths[q], codes, q)
    return tuple(cost), tuple(paths), tuple(exits)


def follow(path: str, codes: str, state: int) -> int:
    at = 0
    for initial in path:
        if initial == "K" and codes[at].lower() == "s":
            state = SYSTEM
        elif initial != "D":
            state = ASSISTANT if state == USER else USER
        at += initial != "I"
    return state


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_LEAF = [("conv", pa.int64()), ("at", pa.int64()), ("codes", pa.string())]
_COSTS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())


def _transfers(batches):
    """Segments of long conversations with their tables of costs."""
    schema = pa.schema([*_LEAF, ("table", _COSTS)])
    return _batches((r | {"table": transfer(r["codes"])} for r in _rows(batches)), schema)


def _ends(batches):
    """Segments from a conversation's last to its first, each with what is still needed after it from each state."""

    def walk():
        conv, ends = None, AT_END
        for r in _rows(batches):
            if r["conv"] != conv:
                conv, ends = r["conv"], AT_END
            table = r.pop("table")
            yield r | {"ends": ends}
            ends = tuple(min(table[4 * a + z] + ends[z] for z in range(4)) for a in range(4))

    return _batches(walk(), pa.schema([*_LEAF, ("ends", _COSTS)]))


def _paths(batches):
    schema = pa.schema([*_LEAF, ("paths", _TEXTS), ("exits", pa.list_(pa.int32())), ("total", pa.int64())])

    def walk():
        for r in _rows(batches):
            ends, alone = r.pop("ends"), False
            if ends is None:
                ends, alone = AT_END, True
            cost, paths, exits = chosen(r["codes"], tuple(ends), alone)
            yield r | {"paths": paths, "exits": exits, "total": cost[START]}

    return _batches(walk(), schema)


class _Conversation:
    """One conversation followed row by row: nothing of it is held but what is asked for."""

    def __init__(self, conv: int) -> None:
        self.conv, self.state, self.path, self.codes = conv, START, iter(()), iter(())
        self.after = START
        self.cost, self.counts = None, dict.fromkeys("bptl", 0)
        self.low = self.high = self.seen = None
        self.turns, self.before, self.audit, self.digest, self.position = 0, None, [], hashlib.sha256(), 0

    def segment(self, r: dict) -> None:
        self.state = self.after
        self.path, self.codes, self.after = iter(r["paths"][self.state]), iter(r["codes"]), r["exits"][self.state]
        self.cost = r["total"] if self.cost is None else self.cost

    def _put(self, edit: str, role: str, text: str) -> dict:
        if self.position:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:".encode() + text.encode("utf-8", "surrogatepass"))
        self.position += 1
        return {"conv": self.conv, "position": self.position, "edit": edit, "role": role, "text": text}

    def _next(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def row(self, r: dict) -> Iterator[dict]:
        code, role, text = next(self.codes), r["role"], r["text"]
        self.counts["t" if code.isupper() else code if code in "bp" else "l"] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.turns += 1
        self.before = role[:1]
        if (turn := r["turn"]) is not None:
            self.low = turn if self.low is None else self.low
            self.seen = (self.seen or 0) + (turn != self.high)
            self.high = turn
        for edit in self.path:
            self.audit.append(edit)
            if edit == "I":
                yield self._put(edit, self._next(), "")
                continue
            if edit == "R":
                yield self._put(edit, self._next(), text)
            elif edit == "K":
                self.state = SYSTEM if role[:1] == "s" else ASSISTANT if self.state == USER else USER
                yield self._put(edit, role, text)
            return

    def end(self) -> Iterator[dict]:
        self.state = self.after
        while self.state in (SYSTEM, USER):
            self.audit.append("I")
            yield self._put("I", self._next(), "")

    def summary(self) -> dict:
        gaps = self.high - self.low + 1 - self.seen if self.seen else 0
        return {"conv": self.conv, "gaps": gaps, "blank": self.counts["b"], "duplicate": self.counts["p"], "truncated": self.counts["t"], "illegal": self.turns,
                "cost": self.cost or 0, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _finish(batches, turns: bool):
    """Rows in order of conversation, place and kind: of each conversation a marker, its segments, and after each the rows in it."""
    kinds = {"conv": pa.int64(), "position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in (TURNS if turns else SUMMARY).split(", ")])

    def walk():
        now = None
        for r in _rows(batches):
            if r["kind"] == 0:
                if now:
                    yield from finished(now)
                now = _Conversation(r["conv"])
            elif r["kind"] == 1:
                now.segment(r)
            else:
                for out in now.row(r):
                    if turns:
                        yield out
        if now:
            yield from finished(now)

    def finished(now):
        for out in now.end():
            if turns:
                yield out
        if not turns:
            yield now.summary()

    return _batches(walk(), schema, 500)


def _solved(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in a fixed order (``at``), and the segments of all conversations with the cheapest edits from each state before them."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "mark"]
    base = turns.withColumn("mark", F.md5("text"))
    # a range of rows a partition: a long conversation lies in many of them, and numbers rise through all
    rows = store(base.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("mark"))
    facts = rows.select("conv", "at", "role", F.md5("text").alias("mark"), F.rtrim("text", F.lit(BLANKS)).alias("text")).select(
        "conv", "at", "role", "mark", F.right("text", F.lit(1)).alias("last"))
    seen = facts.groupBy("conv", "role", "mark").agg(F.min("at").alias("first"))
    initial = F.substring("role", 1, 1)
    sound = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = (F.when(F.col("last") == "", "b").when(F.col("at") > F.col("first"), "p").when(~F.col("last").isin(".", "!", "?"), F.upper(sound)).otherwise(sound))
    coded = facts.join(seen, ["conv", "role", "mark"]).select("conv", "at", F.shiftright("at", 33).alias("part"), code.alias("code"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy("at"))
    cut = coded.withColumn("segment", F.floor((place - 1) / SEGMENT)).groupBy("conv", "part", "segment").agg(
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows"))
    near = Window.partitionBy("conv").orderBy("at")
    leaves = store(cut.select("conv", "at", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes")).withColumn(
        "alone", F.lag("at").over(near).isNull() & F.lead("at").over(near).isNull()))
    several = leaves.filter("NOT alone").drop("alone").repartition(n, "at").mapInArrow(_transfers, LEAF + ", table array<long>")
    ended = several.repartition(n, "conv").sortWithinPartitions("conv", F.desc("at")).mapInArrow(_ends, LEAF + ", ends array<long>")
    open_ = ended.repartition(n, "at").unionByName(leaves.filter("alone").drop("alone").withColumn("ends", F.lit(None).cast("array<long>")))
    return rows, open_.mapInArrow(_paths, PATHS)


def _followed(turns: DataFrame, everything: DataFrame, as_turns: bool) -> DataFrame:
    rows, segments = _solved(turns)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = everything.distinct().select("conv", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"))
    union = marks.unionByName(segments.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(
        rows.select("conv", "at", F.lit(2).alias("kind"), "turn", "role", "text"), allowMissingColumns=True)
    ordered = union.repartition(n, "conv").sortWithinPartitions("conv", "at", "kind")
    return ordered.mapInArrow(lambda it: _finish(it, as_turns), TURNS if as_turns else SUMMARY)


def _plain(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        text(role_col).alias("role"), text(text_col).alias("text"))


def _named(out: DataFrame, conv_col: str) -> DataFrame:
    return out.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias(conv_col), *out.columns[1:])


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) with a quarter of the rows dropped, emptied, unpunctuated, repeated or reroled by a checksum of
    ``conv:turn``: remainders 0 to 4 of 20."""
    name = lambda c: F.coalesce(F.when(F.col(c) != NO_ID, F.col(c)).cast("string"), F.lit(" "))
    k: Column = F.crc32(F.concat(name("conv"), F.lit(":"), name("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return turns.filter(k != 0).select("conv", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                       F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", prepare=None,
           as_turns: bool = False) -> DataFrame:
    """Faults and cheapest repair of every conversation: one row each, or with ``as_turns`` the repaired turns (position, edit, role, text).

    Rows stand by turn (nulls first), then role and MD5 of the text. A row's first fault counts: blank, duplicate (role and text seen
    earlier in the conversation), truncated (its last character that is no blank is none of ``.!?``). Edits: keep (0), rerole to user
    or assistant (1), delete (2; a must for blank and duplicate rows), insert an empty user or assistant turn (5); a truncated row that
    stays adds 5. What remains has the role initials ``(s?(ua)+)?``; of the cheapest edits the first in ASCII order of D, I, K, R is taken.

    Each segment of 16 rows is searched by iterative-deepening A* with a table of failed states. A conversation of one segment is
    searched from the start to the end. Those of several are searched from each state to each state, which gives tables of costs; from
    the last to the first they give what is still needed after each segment, and under that bound each segment's depth-first search
    finds the edits that the search of the whole conversation would find. Rows are dealt in ranges, so one conversation spreads over
    many tasks; only its digest and audit, which are one string each, are made in a stream of its rows in one task, a row at a time.

    ``prepare`` changes the rows (conv, turn, role, text) first, and conversations that lose all rows are still returned. Null roles and
    texts are one space; a null conversation is one of its own; equal rows of one turn are repeats. A conversation without rows has
    zeros, an empty audit and the digest of the empty string. Other columns are ignored; an empty table gives no rows.
    """
    rows = _plain(turns, conv_col, turn_col, role_col, text_col)
    return _named(_followed(prepare(rows) if prepare else rows, rows.select("conv"), as_turns), conv_col)

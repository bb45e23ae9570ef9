"""Chat formatting as prefix trees: shared turns once, depth first, with position ids and ancestor attention intervals."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelens.llm.native import NO_ID, store

OPEN, SPLIT, CLOSE = "### ", ": ", " </turn>\n"
LIST = pa.list_(pa.int64())
PACK = "pack long, text string, ids array<long>, start array<long>, stop array<long>, parent array<long>, position array<long>, seen array<array<long>>, loss array<array<long>>, leaf_keys array<string>, leaves array<long>"

SCHEMA = pa.schema([("pack", pa.int64()), ("text", pa.string()), *[(c, LIST) for c in ("ids", "start", "stop", "parent", "position")],
                    *[(c, pa.list_(LIST)) for c in ("seen", "loss")], ("leaf_keys", pa.list_(pa.string())), ("leaves", LIST)])


def escape(text: str, role: bool = False) -> str:
    """Texts keep no control string: a backslash precedes each backslash, # and <, in roles also each colon."""
    return re.sub(r"([\\#<:])" if role else r"([\\#<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse_turn(piece: str) -> tuple[str, str, tuple[int, int]]:
    """Role, text, and where the escaped text is in a formatted turn."""
    m = re.match(r"### ((?:\\.|[^\\:])*): ", piece, re.S)
    if not m or not piece.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    a, z = m.end(), len(piece) - len(CLOSE)
    return unescape(m.group(1)), unescape(piece[a:z]), (a, z)


def _tree(conversations: list[tuple[str, list[tuple[str, str]]]]):
    """Nodes (parent, role, text) in depth-first order and the node of each conversation's last turn."""
    kids: list[dict] = [{}]
    up, what, last = [-1], [("", "")], {}
    for key, turns in conversations:
        at = 0
        for turn in turns:
            if turn not in kids[at]:
                kids[at][turn] = len(kids)
                kids.append({})
                up.append(at)
                what.append(turn)
            at = kids[at][turn]
        last[key] = at
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += list(kids[node].values())[::-1]
    number = {node: i - 1 for i, node in enumerate(order)}  # the root has no turn: -1
    nodes = [(number[up[n]], *what[n]) for n in order[1:]]
    return nodes, {key: number[n] for key, n in last.items()}


def lay_out(pack: int, conversations: list, learn: Sequence[str], tokenizer) -> dict:
    """A pack's sequence. Units are code points, or tokens when there is a tokenizer."""
    nodes, last = _tree(conversations)
    text, ids, start, stop, position, seen, loss = [], [], [], [], [], [], []
    at = 0
    for parent, role, body in nodes:
        parts = [OPEN + escape(role, True) + SPLIT, escape(body), CLOSE]
        text += parts
        if tokenizer:
            coded = [e.ids for e in tokenizer.encode_batch(parts, add_special_tokens=False)]
            sizes = [len(c) for c in coded]
            ids += sum(coded, [])
        else:
            sizes = [len(p) for p in parts]
        start.append(at)
        stop.append(at + sum(sizes))
        position.append(0 if parent < 0 else position[parent] + stop[parent] - start[parent])
        above = [] if parent < 0 else list(seen[parent])
        if parent >= 0:
            if above and above[-1] == start[parent]:
                above[-1] = stop[parent]
            else:
                above += [start[parent], stop[parent]]
        seen.append(above)
        if role in learn:
            loss.append([at + sizes[0], at + sizes[0] + sizes[1]])
        at = stop[-1]
    return {"pack": pack, "text": "".join(text), "ids": ids if tokenizer else None, "start": start, "stop": stop, "parent": [n[0] for n in nodes], "position": position,
            "seen": seen, "loss": loss, "leaf_keys": list(last), "leaves": list(last.values())}


def position_ids(row) -> list[int]:
    """Per unit of a pack its position in each conversation it is part of."""
    return [p + i for a, z, p in zip(row["start"], row["stop"], row["position"]) for i in range(z - a)]


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, key, root, turns): the turns in order, a key of all of them and one of the first. Null roles and texts are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("conv"), F.struct(F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    sized = lambda t: F.concat(F.char_length(t["role"]).cast("string"), F.lit(":"), F.char_length(t["text"]).cast("string"), F.lit(":"), t["role"], t["text"])
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.select("conv", F.sha2(F.array_join(F.transform("turns", sized), ""), 256).alias("key"), F.xxhash64(sized(F.get("turns", F.lit(0)))).alias("root"),
                        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def pack_trees(convs: DataFrame, pack_size: int = 256, learn: Sequence[str] = ("assistant",), tokenizer: str | None = None) -> DataFrame:
    """Packed sequences of all distinct conversations of about ``pack_size`` each.

    Trees (conversations with the same first turn) stay whole; small trees share packs, a tree of more conversations than a pack is
    dealt by hash into several, each repeating its shared turns once, so neither packs nor tasks grow with a hot first turn.
    Columns: text, ids (with ``tokenizer``, the path of a tokenizers file), and per turn in depth-first order start, stop, parent (its
    turn before, -1: none), position (of its first unit), seen (its ancestors' intervals as start, stop, start, stop; a unit also sees its own turn up to itself); loss (intervals
    of texts of the ``learn`` roles); leaf_keys and leaves (last turn of each conversation).
    """
    one_each = convs.select("key", "root", "turns").dropDuplicates(["key"])
    size = one_each.groupBy("root").agg(F.count("*").alias("n"))
    total = one_each.select("key").count()
    share = F.when(F.col("n") > pack_size, F.xxhash64("root", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / pack_size)))).otherwise(
        F.pmod(F.xxhash64("root"), F.lit(-(-total // pack_size) or 1)))
    dealt = one_each.join(size, "root").select(share.alias("pack"), "key", "turns")

    def lay(key, table):
        tok = None
        if tokenizer:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer)
            tok.encode_special_tokens = True
        listed = sorted(([(t["role"], t["text"]) for t in turns], k) for k, turns in zip(table["key"].to_pylist(), table["turns"].to_pylist()))
        return pa.Table.from_pylist([lay_out(key[0].as_py(), [(k, turns) for turns, k in listed], learn, tok)], SCHEMA)

    return dealt.groupBy("pack").applyInArrow(lay, PACK)


READ = "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            masked = dict(map(tuple, r["loss"]))
            turns = [parse_turn(r["text"][a:z]) for a, z in zip(r["start"], r["stop"])]
            for key, leaf in zip(r["leaf_keys"], r["leaves"]):
                path = []
                while leaf >= 0:
                    path.append(leaf)
                    leaf = r["parent"][leaf]
                whole, learnt, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0
                for i in reversed(path):
                    role, text, (a, _) = turns[i]
                    whole.update(f"{role}\n{text}\n".encode())
                    total += r["stop"][i] - r["start"][i]
                    at = r["start"][i] + a
                    if at in masked:
                        said = unescape(r["text"][at:masked[at]])
                        learnt.update(said.encode())
                        chars += len(said)
                out.append((key, len(path), whole.hexdigest(), chars, learnt.hexdigest(), total))
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)


def read_back(packs: DataFrame) -> DataFrame:
    """Per conversation key what the packed sequences (in code points) hold: turns, and what is under the loss mask."""
    return packs.select("text", "start", "stop", "parent", "loss", "leaf_keys", "leaves").mapInArrow(_read, READ)


def round_trip(turns: DataFrame, **columns) -> DataFrame:
    """conv_id and the digests of ``read_back`` for each conversation.

    Rows are ordered by turn (null first), then role and text; repeated rows are turns of their own; a null id is one conversation.
    An empty table gives no rows; empty texts are turns; texts with control strings come back unchanged.
    """
    convs = store(conversations(turns, **columns))
    out = convs.select("conv", "key").join(read_back(pack_trees(convs)), "key")
    return out.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), *[c.split()[0] for c in READ.split(", ")[1:]])

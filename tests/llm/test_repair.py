"""Conversation repair against a table of all edits in plain Python."""

import hashlib
import itertools
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tidelens.llm import repair as R

TURNS = "conv_id long, turn long, role string, text string, cost string, kind int, at string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) of rows (initial, role, text, fault) by going forward through every state."""
    follows = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    best = {0: (0, "", ())}

    def inserted(table):
        out = dict(table)
        for _ in range(2):
            for q, (cost, audit, put) in list(out.items()):
                into, name = follows[q]
                new = (cost + 5, audit + "I", (*put, (name, "")))
                if into not in out or new[:2] < out[into][:2]:
                    out[into] = new
        return out

    for c, role, text, fault in rows:
        after = {}
        for q, (cost, audit, put) in inserted(best).items():
            into, name = follows[q]
            late = 5 * (fault == "truncated")
            moves = [(q, cost + 2, audit + "D", put)]
            if fault not in ("blank", "duplicate"):
                if c == "s" and q == 0:
                    moves.append((1, cost + late, audit + "K", (*put, (role, text))))
                elif c == name[0]:
                    moves.append((into, cost + late, audit + "K", (*put, (role, text))))
                moves.append((into, cost + 1 + late, audit + "R", (*put, (name, text))))
            for to, *new in moves:
                if to not in after or tuple(new[:2]) < after[to][:2]:
                    after[to] = tuple(new)
        best = after
    done = inserted(best)
    return min(done[q] for q in (0, 3) if q in done)


def plain(rows):
    """The summary of the rows (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.md5(v[2].encode()).hexdigest()))
    seen, coded, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        end = text.rstrip(BLANKS)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        coded.append((role[:1], role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, put = cheapest(coded)
    pairs = [a[0] + b[0] for a, b in itertools.pairwise(coded)]
    return dict(gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts, illegal=sum(p not in ("su", "ua", "au") for p in pairs), cost=cost, audit=audit,
                repaired_sha256=hashlib.sha256("\n".join(f"{r}:{x}" for r, x in put).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="suaxSUAXbp", max_size=14))
def test_search_finds_the_first_of_the_cheapest(codes):
    faults = {"b": "blank", "p": "duplicate"}
    rows = [(c.lower(), c, "", faults.get(c) or ("truncated" if c.isupper() else None)) for c in codes]
    cost, audit, _ = cheapest(rows)
    got, path = R.Search(codes, R.AT_END).cheapest(R.START)
    ends = {R.SYSTEM: "II", R.USER: "I"}
    assert (got, path + ends.get(R.follow(path, codes, R.START), "")) == (cost, audit)
    assert R.lower_bounds(codes)[0] <= cost


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="suaUAbp", min_size=1, max_size=8), st.text(alphabet="suaUAbp", min_size=1, max_size=8))
def test_tables_of_segments_compose(a, b):
    ends = tuple(min(R.transfer(b)[4 * q + z] + R.AT_END[z] for z in range(4)) for q in range(4))
    whole = R.Search(a + b, R.AT_END).cheapest(R.START)
    cost, paths, exits = R.chosen(a, ends, False)
    assert cost[0] == whole[0]
    second = R.chosen(b, R.AT_END, False)[1][exits[0]]
    assert paths[0] + second == whole[1]


def _check(spark, rows, **how):
    got = {r["conv_id"]: r.asDict() for r in R.repair(spark.createDataFrame(rows, TURNS), **how).collect()}
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t, r, x))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == plain(turns), c
    return got


def test_odd_rows_and_a_conversation_of_many_segments(spark):
    row = lambda c, t, r, x: (c, t, r, x, "x", 1, None)
    rows = [row(1, 0, "user", "Hi."), row(1, 1, "assistant", "Yes."), row(2, None, None, None), row(2, None, "user", "a."), row(2, 5, "assistant", "b"),
            row(None, 0, "user", "q?"), row(None, 0, "user", "q?"), row(None, 1, "assistant", "x" * 200_000 + "!"), row(3, 0, "system", "Only."),
            row(4, 0, "", ""), row(5, 7, "umpire", "É🎉.\t\n"), row(5, 9, "also", "so."), row(6, 1, "user", "NUL\x00in."), row(6, 1, "user", "tie."), row(6, 3, "assistant", " . ")]
    roles = ["user", "assistant", "assistant", "user", "system", "tool"]
    for i in range(700):
        rows.append(row(9, i - i % 3 if i % 50 else None, roles[(i * 7 + i // 5) % 6 if i % 4 == 0 else i % 2], ["Good.", "cut", "", f"Same {i % 9}!"][(i * 5 + i // 11) % 4] if i % 5 == 0 else f"Turn {i}."))
    got = _check(spark, rows)
    assert len(got[9]["audit"]) >= 700
    turns = R.repair(spark.createDataFrame(rows, TURNS), as_turns=True).filter("conv_id = 9").orderBy("position").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == got[9]["repaired_sha256"]


@pytest.mark.parametrize("segment", [1, 3])
def test_result_does_not_depend_on_the_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    _check(spark, [(c, i, "sua"[(i * c) % 3], ["a.", "b", ""][(i + c) % 3] if i % 2 else f"{i}.", "x", 1, None) for c in range(1, 6) for i in range(9)])


def test_damage_and_empty_tables(spark, root):
    table = spark.read.parquet(f"{root}/conversations.parquet")
    out = {r["conv_id"]: r.asDict() for r in R.repair(table, prepare=R.damage).collect()}
    by = {}
    for r in table.collect():
        role, text = (r["role"] if r["role"] is not None else " "), (r["text"] if r["text"] is not None else " ")
        k = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role = "user" if k == 4 else role
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        by.setdefault(r["conv_id"], []).extend([(r["turn"], role, text)] * {0: 0, 3: 2}.get(k, 1))
    assert {c: {k: v for k, v in x.items() if k != "conv_id"} for c, x in out.items()} == {c: plain(x) for c, x in by.items()}
    assert R.repair(spark.createDataFrame([], TURNS)).count() == 0
    lost = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = R.repair(spark.createDataFrame([(lost, 0, "user", "a.", "x", 1, None)], TURNS), prepare=R.damage).collect()[0]
    assert (r["cost"], r["audit"], r["gaps"], r["repaired_sha256"]) == (0, "", 0, hashlib.sha256(b"").hexdigest())

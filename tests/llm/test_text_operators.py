"""Words, lines, shingles, benchmark windows, mixing and licences against plain Python."""

import random
import re
import textwrap
from pathlib import Path

import numpy as np
import plain as H
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidelens.llm import decontam, licences, line_dedup, mixing, ngram_join, text as T
from tidelens.llm.components import components
from tidelens.llm.flow import Flow

DOC = "doc_id long, text string, source string, n_lines string, component_id int, path string"


def docs(spark, texts, sources=None):
    """Documents with columns whose names clash with results."""
    rows = [(i, t, (sources or {}).get(i), "x", 1, None) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOC)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zZé\t\n\x0b🎉", max_size=40)), max_size=8), st.integers(3, 30))
def test_words_are_those_of_the_pattern(texts, piece):
    before, T.PIECE = T.PIECE, piece
    try:
        w = T.all_words(*T.buffers(pa.array(texts, pa.string())))
    finally:
        T.PIECE = before
    want = [(i, x) for i, t in enumerate(texts) for x in H.words(t)]
    assert w.doc.tolist() == [i for i, _ in want]
    seen = {}
    for h, (_, x) in zip(w.hashes.tolist(), want):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 100), (5, 5), (None, 3)] + [(1000 + i, 1000) for i in range(50)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(10, 41)} == {10} and got[100] == 7 == got[7] and {got[1000 + i] for i in range(50)} == {1000}
    assert 5 not in got and 3 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


LINE = "The same line of Text again and again"


def test_lines(spark):
    texts = {i: f"head {i} is a line of its own\n{LINE}\n\n  {LINE.upper()}\t\nshort\nshort" for i in range(5)}
    texts |= {10 + i: t for i, t in enumerate(H.ODD)} | {30: LINE, 31: f"\n{LINE}\n", 32: "É" * 25, 33: "é" * 25, 34: "É" * 25, 35: " É" + "É" * 24}
    out = line_dedup.dedup_lines(docs(spark, texts))
    want = H.kept_lines(texts)
    assert {r["doc_id"]: (r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"], r["text"]) for r in out.collect()} == want
    assert out.columns == [*docs(spark, {}).columns, "line_dedup"]
    again = line_dedup.dedup_lines(out)  # a result column of that name is replaced
    assert again.columns == out.columns


def test_lines_of_repeated_and_missing_ids(spark):
    rows = [(1, LINE), (1, LINE), (1, f"{LINE}\nmore of this document"), (2, LINE), (None, LINE)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, ""), (1, ""), (1, "more of this document"), (2, LINE)]
    two = line_dedup.dedup_lines(spark.createDataFrame(rows[:4], "doc_id long, text string"))  # one id counts once
    assert two.filter("line_dedup.n_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, shared = {}, [word() for _ in range(60)]
    for b in range(12):
        base = [word() for _ in range(rng.choice([6, 12, 30, 80, 200]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[:int(len(copy) * rng.uniform(0.8, 1))]
            if rng.random() < 0.3:
                copy += shared
            texts[len(texts)] = " ".join(copy) if rng.random() < 0.7 else "\n".join(copy).upper()
    texts |= {200 + i: t for i, t in enumerate(H.ODD)} | {300: "one two", 301: "ONE  two", 302: "two one"}
    return texts


@pytest.mark.parametrize("n, num, den, shingles", [(5, 80, 100, 200_000), (4, 85, 100, 150), (2, 80, 100, 60)])
def test_near_duplicates(spark, monkeypatch, n, num, den, shingles):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", shingles)  # small ones make many groups of one family
    texts = _corpus()
    got = ngram_join.near_duplicates(docs(spark, texts), n=n, num=num, den=den).collect()
    want = H.near(texts, n, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert sum(c != i for i, (_, c) in want.items()) > 10


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (3, base), (5, base.upper()), (7, base + " tail"), (9, "other text of six words here"), (None, "no id has this text of words"), (8, "no id has this text of words"), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("mine"))
    out = ngram_join.keep_one(df)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 9, 11, 12] and out.columns == df.columns
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_counts_of_shared_shingles_are_added_up_by_text():
    import pyarrow as pa

    texts = [" ".join(f"w{(i * 7 + j * (1 + i % 3)) % 90}" for j in range(60)) for i in range(40)]
    column = pa.array(texts)
    row, h = ngram_join.shingle_sets(column, 4)
    _, keys, _ = ngram_join.content_keys(row, h, len(texts))
    held = {}
    for r, x in zip(row.tolist(), h.tolist()):
        held.setdefault(x, set()).add(int(keys[r]))
    want = {}
    for r, x in {(int(keys[r]), x) for r, x in zip(row.tolist(), h.tolist())}:
        if len(held[x]) > 1:
            want[r] = want.get(r, 0) + 1
    dealt = list(ngram_join._token_rows([pa.RecordBatch.from_arrays([column], ["text"])], 4, 30))
    by_task = [[b.filter(pa.array([s % 6 == p for s in b.column("shard").to_pylist()])) for b in dealt] for p in range(6)]
    told = [b for task in by_task for b in ngram_join._shared(task, 5)]
    assert sum(b.num_rows for b in told) <= 6 * 5  # was one for each text and shard
    got = {}
    for bucket in range(5):
        for b in ngram_join._added([t.filter(pa.array([x == bucket for x in t.column("bucket").to_pylist()])) for t in told]):
            new = dict(zip(b.column("k").to_numpy().view("uint64").tolist(), b.column("m").to_pylist()))
            assert not new.keys() & got.keys()
            got.update(new)
    assert want and got == want
    assert not list(ngram_join._shared([], 5)) and not list(ngram_join._added([]))


def test_bytes_of_shingles_do_not_grow_with_shards():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    column = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10**6, 200)) for _ in range(150)])

    def sent(shards):
        rows = list(ngram_join._token_rows([pa.RecordBatch.from_arrays([column], ["text"])], 5, shards))
        tasks = [list(ngram_join._shared([b.filter(pa.array([s == i for s in b.column("shard").to_pylist()])) for b in rows], 1)) for i in range(shards)]
        size = lambda told: sum(len(x or b"") for b in told for c in ("keys", "counts", "tokens") if c in b.schema.names for x in b.column(c).to_pylist() if not isinstance(x, list))
        return size(rows), sum(len(x) for t in tasks for b in t for c in ("counts",) for xs in b.column(c).to_pylist() for x in xs)

    few, many = sent(4), sent(300)
    assert many[0] < 1.5 * few[0] and many[1] < few[0] / 4  # keys and counts for each text and shard had twice the bytes of the shingles


def test_a_sieve_lets_all_its_ids_and_few_others_through(spark):
    from tidelens.functions.sieve import sieve

    ids = spark.range(0, 3000, 3).union(spark.createDataFrame([(None,), (-5,)], "id long"))
    passed = {r["id"] for r in spark.range(-10, 3000).union(spark.createDataFrame([(None,)], "id long")).filter(sieve(ids)(F.col("id"))).collect()}
    assert passed >= {*range(0, 3000, 3), None, -5} and len(passed) < 1020
    assert not spark.range(100).filter(sieve(ids.limit(0))(F.col("id"))).count()


def test_texts_are_joined_only_where_they_can_matter(spark):
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000, base[7] + " tail"), (1001, base[8]), (5, "another text under an id that is there"), (None, base[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.keep_one(df)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == sorted([(False, i) for i in range(300) if i != 9] + [(True, 0)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 2


def test_scheme_leaves_a_part_in_common():
    rng = np.random.default_rng(5)
    s = ngram_join.Scheme(80, 100)
    for size in (7, 9, 20, 50, 51, 77, 300, 1500):
        for _ in range(15):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            out = int(rng.integers(0, size // 9 + 1))
            b = np.concatenate([a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 9 + 1)), dtype=np.uint64)])
            both, whole = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both < 80 * whole or both == whole:
                continue
            keys = []
            for x in (np.sort(a), np.sort(b)):
                _, k = ngram_join.part_keys(np.zeros(len(x), int), x, np.array([len(x)]), s)
                keys.append(set(k.tolist()))
            assert keys[0] & keys[1]


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def test_leaks(spark):
    w = ITEM.split()
    texts = {1: "before " + ITEM.upper() + " after", 2: " ".join(w[:13]), 3: " ".join(w[:12]), 4: "x-" + "--".join(w[2:15]) + " y" * 400,
             5: "tiny item", 6: "a tiny item, a Tiny ITEM! and more", 7: " ".join(w[::-1]), 8: ITEM + " " + ITEM, 9: "été TINY ITEM"}
    texts |= {20 + i: t for i, t in enumerate(H.ODD)}
    items = [(1, ITEM), (2, "tiny item"), (3, ITEM.lower() + " rho"), (4, None), (5, "!!"), (10, "tiny item"), (None, "tiny item")]
    bench = spark.createDataFrame([(k, t, "c") for k, t in items], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan(docs(spark, texts), bench).collect()}
    assert got == H.leaks(texts, [x for x in items if x[0] is not None])
    bad = {i for i, (n, hit, _) in got.items() if hit and 20 * hit >= n}
    kept = decontam.remove_contaminated(docs(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - bad and 1 in bad and 4 not in bad
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs(spark, texts), none).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontam.scan(docs(spark, {}), bench).count() == 0


def test_leaks_row_by_row_and_nearby(spark):
    rows = [(1, ITEM), (1, "clean text"), (None, ITEM), (2, ITEM.replace("gamma", "gamma extra word"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontam.scan(df, bench).collect()) == [(0, 16), (1, 0), (1, 16), (2, 13)]
    near = decontam.Index(df, bench, rarest=2).near(slop=3)
    assert near.select("d").distinct().count() == 3  # ids 1 and 2 and the one without


def test_flow_takes_first_copies_first():
    f = Flow()
    f.add("a", "t", 10)
    first, second = f.add("s", "p", 6, 0), f.add("s", "p", 6, 1)
    f.add("p", "a", 12)
    other = f.add("s", "q", 3, 0)
    f.add("q", "a", 6)
    assert f.run("s", "t") == 10 and (f.used(first), f.used(second), f.used(other)) == (6, 1, 3)


def test_shares_stop_at_the_cap():
    t = mixing.share_targets({"a": 10, "b": 1000, "c": 500, None: 0})
    assert t["a"] == 20 and t[None] == 0 and abs(t["b"] + t["c"] - (1.5 * 1510 - 20)) < 1e-6
    assert t["b"] <= 2000 and t["c"] == 1000
    assert mixing.share_targets({}) == {} and mixing.share_targets({"x": 0}) == {"x": 0.0}


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    texts = {i: " ".join("w" for _ in range(rng.randrange(0, 40))) for i in range(900)} | {1000: None, 1001: ""}
    sources = {i: rng.choice(["big", "big", "big", "mid", "small", None]) for i in texts}
    df = docs(spark, texts, sources)
    run = lambda: {r["doc_id"]: r for r in mixing.mix(df, F.array("source"), mixing.count_words(F.col("text")), bucket_rows=50).collect()}
    got = run()
    sizes = {}
    for i, t in texts.items():
        sizes[sources[i]] = sizes.get(sources[i], 0) + len(H.words(t))
    want, taken = mixing.share_targets(sizes), {}
    for i, r in got.items():
        assert r["size"] == len(H.words(texts[i])) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[sources[i]] = taken.get(sources[i], 0) + r["taken"]
    assert set(got) == set(texts) and all(abs(taken[s] - want[s]) <= 45 for s in want)
    assert {i: r["taken"] for i, r in run().items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(docs(spark, {}), F.array("source"), mixing.count_words(F.col("text"))).count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 else ["a"], 10) for i in range(300)] + [(900, [], 10), (901, None, 10), (902, ["b"], None)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    out = mixing.mix(df, F.col("sources"), F.col("size"), targets=lambda s: {"a": 1000.0, "b": 1500.0}, bucket_rows=40).collect()
    used = {"a": 0, "b": 0}
    for r in out:
        assert len(r["uses"]) <= 2 and r["taken"] == 10 * len(r["uses"]) or not r["size"]
        for u in r["uses"]:
            assert u["source"] in r["sources"]
            used[u["source"]] += u["words"]
    assert abs(used["a"] - 1000) <= 20 and abs(used["b"] - 1500) <= 20 and max(len(r["uses"]) for r in out) == 1 and len(out) == 303


def test_licences(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    files = {"a/LICENSE": mit, "a/b/c.py": "code of the file", "a/b/d.py": f"# x\n{gpl}\ncode", "e/f.py": "the work is here", "a/b/deep/COPYING": gpl + "\n" + mit,
             "a/b/deep/x/y.txt": None, "top.txt": "", "z/NOTICE.txt": "nothing of that kind", "z/y": "under the license of nobody and so on", "long.txt": mit + "\n" + "word " * 9000}
    df = spark.createDataFrame([(p, t, "own") for p, t in files.items()] + [(None, mit, "own"), ("a/b/c.py", "again", "own")], "path string, text string, licence string")
    got = {r["path"]: (r["own"], r["inherited"], r["from_dir"], r["licence"]) for r in licences.scan(df).collect()}
    assert got["a/b/c.py"] == (None, "MIT", "a", "MIT") and got["a/b/d.py"][0] == "GPL-3.0" and got["e/f.py"] == (None, None, None, None)
    assert got["a/b/deep/x/y.txt"][1:3] == (got["a/b/deep/COPYING"][0], "a/b/deep") and got["a/LICENSE"][0] == "MIT" == got[""][0] == got["long.txt"][0]
    assert got["z/y"][3] is None and got["z/NOTICE.txt"][3] is None and len(got) == 11
    assert licences.scan(df.limit(0)).count() == 0


def test_licence_headers_and_full_texts(spark):
    """Wrapped headers, full texts between other words, and SPDX tags; general prose about software is none."""
    texts = dict(reversed(licences.licence_texts()))
    wrap = lambda text, width, lead: "\n".join(lead + line for line in textwrap.wrap(" ".join(text.split()), width))
    files = {f"{name}/LICENSE": "Copyright (c) 2020 Some One\n\n" + wrap(text, 70, "") for name, text in licences.licence_texts()}
    files |= {f"{name}/src/a.c": "int main() { return 0; }\n" for name in texts}
    headers = {"gpl2.py": "GPL-2.0.header", "lgpl.py": "LGPL-2.1.header", "mpl.py": "MPL-2.0.header", "apache.py": "Apache-2.0.header", "isc.py": "ISC", "by.py": "CC-BY-4.0.header"}
    folder = Path(licences.__file__).with_name("licence_texts")
    files |= {name: "#!/bin/sh\n" + wrap((folder / f"{h}.txt").read_text(), 50, " # ") + "\n" + "x = call(y)\n" * 300 for name, h in headers.items()}
    files |= {"tag.c": "// SPDX-License-Identifier: 0BSD\nint x;", "two.c": "/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "prose.txt": "the software is used under the terms of the contract and the license of the work " * 40}
    got = {r["path"]: r for r in licences.scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    for name in texts:
        assert got[f"{name}/LICENSE"]["own"] == name == got[f"{name}/src/a.c"]["inherited"]
    for name, h in headers.items():
        assert got[name]["own"] == h.removesuffix(".header")
    assert got["tag.c"]["own"] == "0BSD" and got["two.c"]["own"] == "MIT OR Apache-2.0" and got["prose.txt"]["licence"] is None


def test_licence_cosines_equal_brute_force(spark):
    texts = ["Released under the MIT License", "released under a license", "Licensed under CC BY 4.0", "mit mit mit license license", "This work is licensed under the GNU General Public License version 2", "plain words"]
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    w = licences.Weights(df, "text", licences.TEMPLATES)
    got = {r["path"]: (r["licence"], r["cosine"]) for r in licences.matches(df, w, threshold=0.3).collect()}
    for i, t in enumerate(texts):
        c = licences._count(t)
        norm = sum((n * w.idf.get(x, w.foreign)) ** 2 for x, n in c.items()) ** 0.5
        best = max(((sum(n * w.idf[x] * m[x] * w.idf[x] for x, n in c.items() if x in m) / norm / w.norm[name], name) for name, m in w.templates.items()), key=lambda b: (round(b[0], 9), [-ord(ch) for ch in b[1]]))
        if best[0] >= 0.3:
            assert got[f"f{i}"][0] == best[1] and abs(got[f"f{i}"][1] - best[0]) < 1e-8
        else:
            assert f"f{i}" not in got
    assert re.fullmatch("[a-z0-9 ]+", " ".join(w.needed(0.75)))

"""Classifier, suffix tree, cover tree, chat packs, archives and the pipeline."""

import base64
import hashlib
import inspect
import io
import math
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import plain as H
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelens.llm import chat_tree, cover_tree, mixing, native, quality, suffix_tree, warc_zip

# --- quality ---------------------------------------------------------------------------------


def _texts(n=600, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    out, label = {}, {}
    for i in range(n):
        w, label[i] = [word() for _ in range(rng.randrange(5, 80))], i % 3 > 0
        if not label[i]:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [w[k // 6 * 6] for k in range(len(w))]
        out[i] = " ".join(w)
    return out, label


def test_quality_learns_from_its_fold_only(spark):
    texts, label = _texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(9000 + i, t, "clash") for i, t in enumerate(H.ODD)], "doc_id long, text string, score string")
    rows = [(i, int(q), i % 2) for i, q in label.items()] + [(7, None, 0), (None, 1, 0), (8, int(label[8]), 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    fold = native.crc_remainder(F.col("doc_id"), 5)
    model = quality.fit(docs, labels, learn=fold != 0)
    out = quality.score_quality(docs, model, out="score")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(texts) + len(H.ODD) and got[9000] == got[9001]
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == label[i] for i in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped, learn=fold != 0)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    none = quality.fit(docs, labels.limit(0))
    assert {r["q"] for r in quality.score_quality(docs, none, out="q").collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


# --- suffix tree ------------------------------------------------------------------------------


def _markov(n=120, seed=3):
    rng = random.Random(seed)
    follow = {(a, b): rng.choice("abcdefgh") for a in "abcdefgh" for b in "abcdefgh"}
    out = {}
    for i in range(n):
        w = ["a", "b"]
        for _ in range(200):
            w.append(follow[w[-2], w[-1]] if rng.random() < 0.8 else rng.choice("abcdefgh"))
        out[i] = " ".join(w)
    return out


def test_suffix_tree_scores(spark):
    texts = _markov() | {900 + i: t for i, t in enumerate(H.ODD)} | {950: "never seen Words"}
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts.items()] + [(None, "a b", 1.0)], "doc_id long, text string, score double")
    learn = (F.col("doc_id") % 4 != 0) & (F.col("doc_id") < 200)
    got = {r["doc_id"]: r for r in suffix_tree.score_texts(docs, learn).collect()}
    counts, total = {}, 0
    for i, t in texts.items():
        if i % 4 and i < 200:
            for x in [*H.words(t), None]:
                counts[x], total = counts.get(x, 0) + 1, total + 1
    for i, t in texts.items():
        w = [*H.words(t), None]
        base = sum(math.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0
    held = [got[i] for i in range(0, 120, 4)]
    assert sum(r["score"] for r in held) > 0.7 * sum(r["base_score"] for r in held)  # two words of context explain most
    assert len(got) == len(texts) + 1
    none = suffix_tree.score_texts(docs, F.lit(None).cast("boolean")).collect()
    assert all(r["train_tokens"] == 0 and math.isclose(r["score"], 0.0, abs_tol=1e-9) for r in none)
    assert suffix_tree.score_texts(docs.limit(0), learn).count() == 0


def _tree_scores(texts, learns, depth=3, least=50, own=4, weight=30.0, gain=6.0):
    """id -> score by dictionaries of all contexts and successors."""
    words = {i: [*H.words(t), None] for i, t in texts.items()}
    after, one = {}, {}
    for i in filter(learns, words):
        for k, x in enumerate(words[i]):
            one[x] = one.get(x, 0) + 1
            for d in range(1, min(depth, k) + 1):
                follow = after.setdefault(tuple(words[i][k - d:k]), {})
                follow[x] = follow.get(x, 0) + 1
    n, v, states = sum(one.values()), len(one), {}
    root = lambda x: (one.get(x, 0) + 1) / (n + v + 1)

    def p(context, x):
        while context and context not in states:
            context = context[1:]
        if not context:
            return root(x)
        mine, rest = states[context]
        return mine[x] if x in mine else rest * root(x)

    for d in range(1, depth + 1):
        found = {}
        for context in (c for c in after if len(c) == d and sum(after[c].values()) >= least):
            total, follow = sum(after[context].values()), {x: c for x, c in after[context].items() if c >= own}
            low = {x: p(context[1:], x) for x in follow}
            mine = {x: (c + weight * low[x]) / (total + weight) for x, c in follow.items()}
            left, mass = total - sum(follow.values()), max(1 - sum(mine.values()), 1e-12)
            if sum(c * math.log(mine[x] / low[x]) for x, c in follow.items()) + left * math.log(mass / max(1 - sum(low.values()), 1e-12)) >= gain:
                found[context] = mine, mass / max(1 - sum(map(root, mine)), 1e-12)
        states |= found
    return {i: sum(math.log10(p(tuple(w[max(0, k - depth):k]), x)) for k, x in enumerate(w)) for i, w in words.items()}, states


def test_suffix_tree_has_rare_successors(spark):
    """A word seen next_count times after a context is its own, though it is no context."""
    texts = _markov()
    for i in range(1, 28, 4):
        texts[i] += " h g f rareword e"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want, states = _tree_scores(texts, lambda i: i % 4)
    assert any("rareword" in mine for mine, _ in states.values()) and {len(c) for c in states} == {1, 2, 3}
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_texts(docs, F.col("doc_id") % 4 != 0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_suffix_tree_has_no_thresholds_of_size(spark):
    """The counts that make a context and a successor do not depend on the number of tokens, and no tree is made by the driver."""
    assert not [x for x in inspect.signature(suffix_tree.score_texts).parameters if x.endswith("_share")]
    texts = _markov(40)
    more = texts | {1000 + i: f"only{i} words{i} of{i} their{i} own{i} " * 40 for i in range(300)}  # 60,000 tokens that share no context
    for t in (texts, more):
        docs = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
        want, states = _tree_scores(t, lambda i: i % 4, least=30, own=3)
        assert ("a", "b") in states
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score_texts(docs, F.col("doc_id") % 4 != 0, context_count=30, next_count=3).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_suffix_tree_sends_no_rare_pairs_in_full(tmp_path):
    """Pairs are asked for by short hashes first: of tens of thousands that occur less than four times next to none is sent as a key."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 200, 4000)) for _ in range(5)]
    docs = pa.RecordBatch.from_pydict({"d": list(range(5)), "text": texts, "learn": [True] * 5})
    coded = [b for i in range(5) for b in suffix_tree._encode([docs.slice(i, 1)])]
    counts = {}
    for pair in (p for t in texts for p in zip(t.split(), t.split()[1:])):
        counts[pair] = counts.get(pair, 0) + 1
    often = sum(len({p for p in zip(t.split(), t.split()[1:]) if counts[p] >= 4}) for t in texts)
    how = suffix_tree._How(3, 3, 50, 4, 30.0, 6.0, 20005, 201)
    for done in (-1, 0):
        asks = list(suffix_tree._next_asks(coded, how, done))
        for b in suffix_tree._answer(asks, how):
            for r in b.to_pylist():
                if r["slice"] >= 0:
                    (tmp_path / f"{done}/slice={r['slice']}").mkdir(parents=True, exist_ok=True)
                    pq.write_table(pa.table({c: b.column(c) for c in ("kind", "shard", "values")}), tmp_path / f"{done}/slice={r['slice']}/{r['kind']}{r['shard']}.parquet")
        how = suffix_tree.replace(how, answers=(*how.answers, f"file://{tmp_path}/{done}"))
    full = sum(len(suffix_tree.unpacked(k, np.uint64)) for b in asks for kind, k in zip(b.column("kind").to_pylist(), b.column("keys").to_pylist()) if kind == "p1")
    assert 0 < often <= full <= 1.2 * often < 0.2 * sum(len(set(zip(t.split(), t.split()[1:]))) for t in texts)


def test_suffix_tree_sends_few_bytes(tmp_path):
    """Contexts are sent by place, sums only by those who tell them, factors to those who need them; pairs as numbers of both parts."""
    rng = np.random.default_rng(4)
    follow = rng.integers(0, 500, (500, 40))
    texts = []
    for _ in range(6):
        w = [0]
        while len(w) < 30_000:
            w.append(follow[w[-1], min(int(rng.exponential(4)), 39)])
        texts.append(" ".join(f"w{x}" for x in w))
    docs = pa.RecordBatch.from_pydict({"d": list(range(6)), "text": texts, "learn": [True] * 6})
    coded = [b for i in range(6) for b in suffix_tree._encode([docs.slice(i, 1)])]
    how = suffix_tree._How(2, 3, 50, 4, 30.0, 6.0, 180_006, 501, wide=1024, spaces=(1024, 16384, 65536))
    sent, told = {}, {}
    for done in (-1, 0, 1):
        asks = list(suffix_tree._next_asks(coded, how, done))
        for r in (r for b in asks for r in b.to_pylist()):
            sent[r["kind"]] = sent.get(r["kind"], 0) + len(r["keys"]) + len(r["values"])
        for b in suffix_tree._answer(asks, how):
            for r in b.to_pylist():
                if r["slice"] >= 0:
                    told[r["kind"]] = told.get(r["kind"], 0) + len(r["values"])
                    (tmp_path / f"{done}/slice={r['slice']}").mkdir(parents=True, exist_ok=True)
                    pq.write_table(pa.table({c: b.column(c) for c in ("kind", "shard", "values")}), tmp_path / f"{done}/slice={r['slice']}/{r['kind']}{r['shard']}.parquet")
        how = suffix_tree.replace(how, answers=(*how.answers, f"file://{tmp_path}/{done}"))
    pairs = sum(len({*zip(t.split(), t.split()[1:])}) for t in texts)
    contexts = sum(len({*t.split()}) for t in texts)
    assert sent["p1"] < 4 * pairs and sent["c1"] + told["c1"] < 25 * contexts


def test_suffix_tree_numbers_read_back():
    rng = np.random.default_rng(5)
    for a in (np.zeros(0, np.uint32), np.arange(3, dtype=np.uint32), rng.integers(0, 1 << 20, 5000).astype(np.uint32), np.array([0, 2**31], np.uint32)):
        assert (suffix_tree._from_lengths(suffix_tree._by_length(a)) == a).all()
        for dtype in (np.uint8, np.uint32, np.int64, np.float64):
            assert (suffix_tree.unpacked(suffix_tree.packed(a.astype(dtype)), dtype) == a.astype(dtype)).all()
    for bits in (1, 7, 20, 37, 64):
        how = suffix_tree._How(3, 3, 50, 4, 30.0, 6.0, wide=1 << (bits // 2), spaces=(1 << (bits - bits // 2),))
        c, w = (rng.integers(0, 1 << n, 3000) if n else np.zeros(3000, np.int64) for n in (bits - bits // 2, bits // 2))
        assert len(np.unique(how.pair(1, c, w))) == len({*zip(c.tolist(), w.tolist())})


def test_states_sum_to_one():
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(0, 1 << 63, 5, dtype=np.uint64))
    text = rng.integers(0, 5, 4000)
    text[1::3] = (text[0::3][:len(text[1::3])] + 1) % 5
    counts = np.bincount(text, minlength=5)
    n, v = 4000 + 700, 5 + 300  # other words hold 700 tokens
    b = suffix_tree._Builder(words, counts, n, v, 30.0, 6.0)
    pair, c = np.unique(text[:-1] * 5 + text[1:], return_counts=True)
    b.add(pair.astype(np.uint64), c, 100)
    triple = {}
    often = {int(p): i for i, p in enumerate(pair[c >= 100])}
    for x, y, z in zip(text, text[1:], text[2:]):
        if int(x * 5 + y) in often:
            k = often[int(x * 5 + y)] * 5 + int(z)
            triple[k] = triple.get(k, 0) + 1
    keys = np.array(sorted(triple))
    b.add(keys.astype(np.uint64), np.array([triple[k] for k in keys]), 100)
    tree = b.done()
    root = 10 ** tree.base
    for state in range(1, len(tree.rest)):
        own = {int(e % 5): g for e, g in zip(tree.edges, tree.gain) if e // 5 == state}
        total = sum(root[w] * 10 ** own[w] for w in own) + 10 ** tree.rest[state] * (1 - sum(root[w] for w in own))
        assert math.isclose(total, 1, rel_tol=1e-9)
    assert len(tree.rest) > 5


# --- cover tree --------------------------------------------------------------------------------


def _vectors():
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            c = rng.normal(size=8)
            for k in range(rng.integers(1, 25)):
                rows.append((len(rows), (c * rng.uniform(0.5, 3) + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])).tolist(), label))
    line = np.eye(8)
    rows += [(len(rows) + k, (line[0] * math.cos(k * 0.15) + line[1] * math.sin(k * 0.15)).tolist(), 2) for k in range(30)]
    same = rng.normal(size=8).tolist()
    rows += [(len(rows) + k, same, 0) for k in range(40)]
    odd = [None, [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [], [1.0], [2.0], [1e200] * 8, [1e-300] * 8]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(odd)]
    return rows + [(len(rows) + k, same, None) for k in range(2)]


def _links(rows, least=0.98):
    groups, n, by = H.Sets([r[0] for r in rows]), {r[0]: 0 for r in rows}, {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v) / np.abs(v).max()
        by.setdefault((label, len(v)), []).append((i, x / np.linalg.norm(x)))
    for g in by.values():
        for k, (i, x) in enumerate(g):
            for j, y in g[:k]:
                if x @ y >= least:
                    n[i] += 1
                    n[j] += 1
                    groups.join(i, j)
    return {i: (n[i], groups.find(i), groups.find(i) == i) for i in n}


@pytest.mark.parametrize("cell, depth", [(1500, 4), (20, 3), (15, 1)])
def test_cover_tree_finds_every_pair(spark, cell, depth):
    rows = _vectors()
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_pairs(df, block=F.col("label"), cell=cell, depth=depth).collect()}
    assert got == _links(rows)


def test_cover_tree_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert cover_tree.near_pairs(spark.createDataFrame([], schema), block=F.col("label")).count() == 0
    got = cover_tree.near_pairs(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, None, 1)], schema), block=F.col("label")).collect()
    assert sorted(((r["vec_id"], r["component_id"], r["kept"]) for r in got), key=str) == [(4, None, False), (5, 5, True), (None, None, True)]


# --- chat --------------------------------------------------------------------------------------

CONTROL = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (2, 0, "user", CONTROL), (2, 1, "assistant", "other"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"),
            (4, 0, None, None), (4, 1, "odd: role\n", "### x: y </turn>\n"), (None, 0, "user", "no id"), (5, None, "user", "x"), (5, None, "user", "x"), (6, 0, "assistant", "\\\\ \\# <<")]
    rows += [(100 + i, k, r, t) for i in range(700) for k, (r, t) in enumerate([("system", "hot"), ("user", f"q{i % 300}"), ("assistant", "é" * (i % 5))])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in chat_tree.round_trip(df).collect()}
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), H.sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), H.sha(said))
        assert r["formatted_chars"] == sum(len(chat_tree.OPEN + chat_tree.escape(r, True) + chat_tree.SPLIT + chat_tree.escape(t) + chat_tree.CLOSE) for _, r, t in turns)
    packs = chat_tree.pack_trees(chat_tree.conversations(df), pack_size=50).collect()
    assert max(len(p["leaf_keys"]) for p in packs) < 200 and len(packs) > 5  # the hot first turn is dealt to several packs
    assert sum(p["text"].count("hot") for p in packs) <= len(packs)  # once each
    assert chat_tree.round_trip(df.limit(0)).count() == 0


def test_positions_and_ancestors():
    p = chat_tree.lay_out(1, [("k1", [("user", "a"), ("assistant", "b")]), ("k2", [("user", "a"), ("assistant", "c"), ("user", "d")]), ("k3", [("user", "z")])], ("assistant",), None)
    ids = chat_tree.position_ids(p)
    assert len(ids) == len(p["text"]) == p["stop"][-1]
    for key, leaf in zip(p["leaf_keys"], p["leaves"]):
        own, path = list(zip(p["seen"][leaf][::2], p["seen"][leaf][1::2])) + [(p["start"][leaf], p["stop"][leaf])], ""
        seen = [i for a, z in own for i in range(a, z)]
        path = "".join(p["text"][i] for i in seen)
        assert [ids[i] for i in seen] == list(range(len(path))) and path.count(chat_tree.OPEN) == {"k1": 2, "k2": 3, "k3": 1}[key]
    assert p["text"].count("### user: a") == 1


def test_chat_tokens_decode_to_the_text():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    p = chat_tree.lay_out(1, [("k", [("user", CONTROL), ("assistant", "été <|endoftext|> 🎉")])], ("assistant",), tok)
    assert tok.decode(p["ids"]) == p["text"] and len(p["ids"]) == p["stop"][-1]
    (a, z), = p["loss"]
    assert chat_tree.unescape(tok.decode(p["ids"][a:z])) == "été <|endoftext|> 🎉"


# --- archives ------------------------------------------------------------------------------------


@pytest.mark.parametrize("force64", [False, True])
def test_zip_members(force64):
    out = io.BytesIO()
    w = warc_zip.ZipWriter(out, force64)
    data = {"archive/data.warc.gz": b"0123456789" * 1000, "indexes/é.cdxj": b"", "x": warc_zip.END + b"\x00" * 30}
    for name, body in data.items():
        w.begin(name)
        w.write(body[:7])
        w.write(body[7:])
        w.end()
    w.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {i.filename: z.read(i) for i in z.infolist()} == data
    found = warc_zip.members(lambda at, n: raw[at:at + n], len(raw))
    assert {m.name: raw[m.offset:m.offset + m.size] for m in found} == data and all(m.method == 0 for m in found)
    with pytest.raises(warc_zip.BadArchive):
        warc_zip.members(lambda at, n: raw[:-30][at:at + n], len(raw) - 30)


def test_zip_of_another_writer():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        z.writestr("a", b"1" * 99)
        with z.open("b", "w", force_zip64=True) as f:
            f.write(b"22")
    raw = out.getvalue()
    assert {m.name: raw[m.offset:m.offset + m.size] for m in warc_zip.members(lambda at, n: raw[at:at + n], len(raw))} == {"a": b"1" * 99, "b": b"22"}


def test_archived_pages(spark):
    pages = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "same"), (5, "http://c", "same"), (9, "http://c", "same"), (3, "http://d", None), (4, "http://e", ""),
             (6, "u", "WARC/1.1\r\n\r\n" * 3), (7, "u", "x" * 300_000), (8, "u", "x" * 300_000), (None, "u", "same")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, refers_to int")
    got = {r["page"]: r for r in warc_zip.archive_pages(df).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(pages)
    for i, _, h in pages:
        body, r = (h or "").encode(), got[native.NO_ID if i is None else i]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
    small = warc_zip.revisits(df, least=100)
    assert {r["page_id"] for r in small.filter("refers_to IS NOT NULL").collect()} == {7}
    assert warc_zip.archive_pages(df.limit(0)).count() == 0


def test_records_are_read_by_range(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50, None) for i in range(25)], "page_id long, url string, html string, refers_to long").coalesce(1)
    folder = f"file://{tmp_path}/w"
    made = warc_zip.write_archives(df, folder, records=10)
    assert made.count() == 3
    got = {r["page"]: bytes(r["payload"]).decode() for r in warc_zip.read_archives(made, folder).collect()}
    assert got == {i: f"page {i} " * 50 for i in range(25)}
    one = next((tmp_path / "w").glob("*.wacz"))
    raw = bytearray(one.read_bytes())
    raw[200] ^= 255
    one.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="Error|BadArchive|damaged"):
        warc_zip.read_archives(made, folder).collect()


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "decontamination", "mixing"]
    good = stages["quality"](spark, docs, root)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    sources = {r["doc_id"]: r["source"] for r in good.collect()}
    assert good.columns == docs.columns and 0 < len(texts) <= docs.count()
    bad = {r["doc_id"] for r in spark.read.parquet(f"{root}/labels.parquet").filter("quality = 1").collect()} - set(texts)
    assert len(bad) <= 2  # clean documents stay
    texts = {i: t for i, (_, _, t) in H.kept_lines(texts).items()}
    texts = {i: texts[i] for i, (_, c) in H.near(texts, 5, 80, 100).items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    texts = {i: texts[i] for i, (n, hit, _) in H.leaks(texts, items).items() if not (hit and 20 * hit >= n)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, root).collect()}
    assert {i: r["size"] for i, r in out.items()} == {i: len(H.words(t)) for i, t in texts.items()}
    sizes = {}
    for i, t in texts.items():
        sizes[sources[i]] = sizes.get(sources[i], 0) + len(H.words(t))
    want = mixing.share_targets(sizes)
    for s in want:
        largest = max(r["size"] for r in out.values() if r["source"] == s)
        assert abs(sum(r["taken"] for r in out.values() if r["source"] == s) - want[s]) <= largest

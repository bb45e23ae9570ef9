"""Plain Python versions of what the operators compute."""

import hashlib
import re

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \t\n\r\x0b\x0c ", "\n\n", "x", "É é ß", " wide ", "NUL\x00in", "🎉 emoji 🎉", "a" * 5000, "word " * 30000]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def near(texts, n, num, den):
    """id -> (set size, component) by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    groups, ids = Sets(texts), sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def kept_lines(texts, least=20, docs=3):
    """id -> (lines, dropped, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    held = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= docs and i != max(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def leaks(texts, items, width=13):
    """id -> (words, hit words, items)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    found = {}
    for k, t in items:
        w = split(t)
        for s in range(max(len(w) - width + 1, 1)) if w else ():
            found.setdefault(tuple(w[s:s + width]), set()).add(k)
    sizes = {len(p) for p in found}
    out = {}
    for i, t in texts.items():
        w, hit, who = split(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (ks := found.get(tuple(w[s:s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    who |= ks
        out[i] = (len(w), len(hit), sorted(map(str, who)))
    return out

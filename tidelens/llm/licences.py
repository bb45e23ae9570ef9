"""Licence scans: sparse TF-IDF cosine of lines, licence files and windows of text to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from tidelens.llm.native import ascii_lower, store

TOKEN_GAP = "[^a-z0-9]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
# Statements by which the four licences name themselves.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), TOKEN_GAP, -1), "")


def _count(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", text.lower()))


class Weights:
    """Inverse document frequencies of the templates' words over all files: ln((1 + files) / (1 + files with the word)) + 1.

    A word that no template has weighs as one that no file has, so foreign words in a line always lower its cosine."""

    def __init__(self, files: DataFrame, text_col: str, templates: dict[str, str]) -> None:
        self.templates = {name: _count(text) for name, text in templates.items()}
        vocabulary = sorted({t for c in self.templates.values() for t in c})
        held = F.array_intersect(tokens(F.coalesce(F.col(text_col), F.lit(""))), F.array(*map(F.lit, vocabulary)))
        # one row per template word and one for the number of files
        rows = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
        found = {r["t"]: r["n"] for r in rows}
        self.files = found.pop("", 0)
        self.idf = {t: math.log((1 + self.files) / (1 + found.get(t, 0))) + 1 for t in vocabulary}
        self.foreign = math.log(1 + self.files) + 1
        self.norm = {name: math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items())) for name, c in self.templates.items()}

    def needed(self, threshold: float) -> list[str]:
        """Words of which a line must have one to reach the threshold: the others together are too light in every template."""
        out = set()
        for name, c in self.templates.items():
            rest = self.norm[name] ** 2
            for t in sorted(c, key=lambda t: (-c[t] * self.idf[t], t)):
                if rest < (threshold * self.norm[name]) ** 2 * (1 - 1e-9):
                    break
                out.add(t)
                rest -= (c[t] * self.idf[t]) ** 2
        return sorted(out)


def matches(files: DataFrame, weights: Weights, path_col: str = "path", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """(path, part, licence, cosine): the best template of each line of a file, and of the whole text of licence files (part -1).

    Ties go to the first name. Only lines with one of the needed words are split into words; that loses none."""
    spark = files.sparkSession
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    pattern = f"(^|[^a-z0-9])({'|'.join(weights.needed(threshold))})([^a-z0-9]|$)"
    base = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), text.alias("text")).filter(F.col("text").rlike(pattern))
    lines = base.select("path", F.posexplode(F.split("text", "\n", -1)).alias("part", "line"))
    whole = base.filter(F.col("path").rlike(LICENCE_FILE)).select("path", F.lit(-1).alias("part"), F.col("text").alias("line"))
    near = lines.union(whole).filter(F.col("line").rlike(pattern))
    # a repeated path may have another text at the same part: the line's hash keeps them apart; equal lines only scale the vector
    words = near.select("path", "part", F.xxhash64("line").alias("x"), F.explode(F.array_remove(F.split("line", TOKEN_GAP, -1), "")).alias("t"))
    idf = F.create_map(*[F.lit(v) for t, w in weights.idf.items() for v in (t, w)])
    counted = words.groupBy("path", "part", "x", "t").agg(F.count("*").alias("n")).withColumn("w", F.col("n") * F.coalesce(F.element_at(idf, F.col("t")), F.lit(weights.foreign)))
    table = spark.createDataFrame([(name, t, n * weights.idf[t] / weights.norm[name]) for name, c in weights.templates.items() for t, n in c.items()], "licence string, t string, u double")
    by_line = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    norms = counted.groupBy("path", "part", "x").agg(by_line)
    dots = counted.join(F.broadcast(table), "t").groupBy("path", "part", "x", "licence").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scored = dots.join(norms, ["path", "part", "x"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold)
    best = scored.groupBy("path", "part").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return best.select("path", "part", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def licence_texts() -> list[tuple[str, str]]:
    """(licence, text): the full texts and standard headers of ``licence_texts``."""
    return [(p.name.removesuffix(".txt").removesuffix(".header"), p.read_text()) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]


class Texts:
    """Long templates as vectors of word pairs: (1 + ln n) times the inverse frequency over the templates."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        words = [re.findall("[a-z0-9]+", text.lower()) for _, text in texts]
        pairs = [Counter(map(" ".join, zip(w, w[1:]))) for w in words]
        held = Counter(p for c in pairs for p in c)
        self.idf = {p: math.log((1 + len(texts)) / (1 + n)) + 1 for p, n in held.items()}
        self.foreign = math.log(1 + len(texts)) + 1
        self.rows = []  # (template, licence, pairs in its text, step of windows, pair, part of the unit vector)
        self.units = []
        for k, ((name, _), c) in enumerate(zip(texts, pairs)):
            weights = {p: (1 + math.log(n)) * self.idf[p] for p, n in c.items()}
            norm, length = math.sqrt(sum(w * w for w in weights.values())), sum(c.values())
            self.units.append({p: w / norm for p, w in weights.items()})
            self.rows += [(k, name, length, max(1, length // 16), p, self.idf[p], u) for p, u in self.units[-1].items()]

    def needed(self, threshold: float) -> list[str]:
        """Words of which a window must have one to reach the threshold: the pairs without them are too light in every template.

        Words of more than five letters are taken first, as short ones are in all prose; any order loses none."""
        held = Counter(w for u in self.units for w in {w for p in u for w in p.split()})
        out: set[str] = set()
        for unit in self.units:
            left = {p: u for p, u in unit.items() if not out & set(p.split())}
            while sum(u * u for u in left.values()) >= threshold**2 * (1 - 1e-9):
                gain: Counter = Counter()
                for p, u in left.items():
                    for w in set(p.split()):
                        gain[w] += u * u if len(w) > 5 else u * u / 1000
                word = max(gain, key=lambda w: (gain[w], held[w], w))
                out.add(word)
                left = {p: u for p, u in left.items() if word not in p.split()}
        return sorted(out)


def passages(files: DataFrame, texts: Texts, path_col: str = "path", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """(path, part, licence, cosine) of windows of a file over line ends, each as long as a template and a 16th of it apart; part -2.

    A file, then a window is opened only if the template's pairs in it could reach the threshold by themselves; that loses none."""
    spark = files.sparkSession
    t = tokens(F.coalesce(F.col(text_col), F.lit("")))
    base = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.xxhash64(text_col).alias("x"), t.alias("t")).filter(F.arrays_overlap("t", F.array(*map(F.lit, texts.needed(threshold)))))
    split = lambda df: df.filter(F.size("t") > 1).select("path", "x", F.posexplode(F.expr("transform(sequence(1, size(t) - 1), i -> concat(t[i - 1], ' ', t[i]))")).alias("pos", "pair"))
    table = F.broadcast(spark.createDataFrame(texts.rows, "template int, licence string, length int, step int, pair string, idf double, u double"))
    held = store(split(base).join(F.broadcast(spark.createDataFrame([(p,) for p in texts.idf], "pair string")), "pair", "left_semi").distinct())
    # first whole files, then their windows
    whole = held.select("path", "x", "pair").distinct().join(table, "pair").groupBy("path", "x", "template").agg(F.sum(F.col("u") * F.col("u")).alias("most"))
    could = store(whole.filter(F.col("most") >= threshold**2 * (1 - 1e-9)).drop("most"))
    windows = F.explode(F.expr("sequence(greatest(0, (pos - length + step) div step), pos div step)")).alias("w")
    hits = held.join(table, "pair").join(could, ["path", "x", "template"], "left_semi").select("path", "x", "template", "licence", "length", "step", "pair", "idf", "u", windows)
    spot = ["path", "x", "template", "licence", "length", "step", "w"]
    dots = hits.groupBy(*spot, "pair", "idf", "u").agg(F.count("*").alias("n")).groupBy(*spot).agg(F.sum((1 + F.log("n")) * F.col("idf") * F.col("u")).alias("dot"), F.sum(F.col("u") * F.col("u")).alias("most"))
    near = store(dots.filter(F.col("most") >= threshold**2 * (1 - 1e-9)))
    if near.isEmpty():  # then no text is read again
        return near.select("path", F.lit(-2).alias("part"), "licence", F.col("dot").alias("cosine"))
    pairs = split(base.join(near.select("path", "x").distinct(), ["path", "x"], "left_semi")).distinct()
    inside = near.select("path", "x", "template", "w", F.explode(F.expr("sequence(cast(w * step as int), cast(w * step + length - 1 as int))")).alias("pos")).join(pairs, ["path", "x", "pos"])
    idf = F.broadcast(spark.createDataFrame(list(texts.idf.items()), "pair string, idf double"))
    weight = (1 + F.log("n")) * F.coalesce("idf", F.lit(texts.foreign))
    norms = inside.groupBy("path", "x", "template", "w", "pair").agg(F.count("*").alias("n")).join(idf, "pair", "left").groupBy("path", "x", "template", "w").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    scored = near.join(norms, ["path", "x", "template", "w"]).select("path", F.lit(-2).alias("part"), "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"))
    return scored.filter(F.col("cosine") >= threshold)


def identifiers(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, part, licence, cosine) of lines with an SPDX tag; the licence is its expression as written."""
    tag = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9(][a-z0-9.+() -]*[a-z0-9.+)]|[a-z0-9])"
    tagged = files.filter(F.col(text_col).rlike("(?i)spdx-license-identifier:"))
    lines = tagged.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.posexplode(F.split(text_col, "\n", -1)).alias("part", "line"))
    said = F.regexp_replace(F.regexp_extract("line", tag, 1), "[ -]+$", "")
    return lines.select("path", "part", said.alias("licence"), F.lit(1.0).alias("cosine")).filter("licence <> ''")


def directories(path: Column) -> Column:
    """All directories of a path, from the root ('') to its own."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.75,
         is_licence: Column | None = None, weights: Weights | None = None, texts: Texts | None = None) -> DataFrame:
    """Per distinct path: own (licence of its best line, SPDX tag or window of text), own_cosine, n_lines (lines that match), inherited, from_dir and licence.

    ``is_licence`` (a condition on path, part and licence of a match) tells which matches speak for their directory; by default those
    in files named LICENSE, COPYING or NOTICE. A directory's licence is the best of these (then the first by name); a file without a
    licence of its own has that of the nearest directory above it, its own included. Null texts are empty and null paths are a file
    '' in the root. Rows sharing a path are one file. Repeated licences and ties are settled by cosine, then name.

    Everything is native: counts over all files, matches of few lines, and joins of distinct directories with licensed ones.
    """
    weights = weights or Weights(files, text_col, templates or TEMPLATES)
    by_line = matches(files, weights, path_col, text_col, threshold).union(identifiers(files, path_col, text_col))
    found = store(by_line.union(passages(files, texts or Texts(licence_texts()), path_col, text_col, threshold)))
    rank = F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))
    own = found.groupBy("path").agg(rank.alias("o"), F.countDistinct(F.when(F.col("part") >= 0, F.col("part"))).alias("n_lines"))
    spoken = found.filter(F.col("path").rlike(LICENCE_FILE) if is_licence is None else is_licence)
    licensed = spoken.withColumn("dir", F.element_at(directories(F.col("path")), -1)).groupBy("dir").agg(rank.alias("l"))
    paths = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path")).distinct().withColumn("home", F.element_at(directories(F.col("path")), -1))
    homes = paths.select("home").distinct().select("home", F.posexplode(directories(F.concat("home", F.when(F.col("home") == "", "x").otherwise("/x")))).alias("depth", "dir"))
    nearest = homes.join(licensed, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "l")).alias("n"))
    out = paths.join(nearest, "home", "left").join(own, "path", "left")
    inherited = F.when(F.col("o").isNull(), F.col("n.l.licence"))
    return out.select("path", F.col("o.licence").alias("own"), (-F.col("o.c")).alias("own_cosine"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), inherited.alias("inherited"),
                      F.when(F.col("o").isNull(), F.col("n.dir")).alias("from_dir"), F.coalesce(F.col("o.licence"), inherited).alias("licence"))

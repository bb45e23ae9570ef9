"""Line deduplication: lines repeated in many documents stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelens.llm.native import BLANKS, NO_ID, ascii_lower


def _keys(text: Column, min_chars: int) -> Column:
    """Per line, in order: two hashes of the normalised line (96 bits together), null for lines that are too short to count."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g")))

    return F.transform(lines, key)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                out: str = "line_dedup") -> DataFrame:
    """Drop lines whose key occurs in at least ``min_docs`` documents, except in the document with the largest id holding it.

    Lines are the parts between line feeds; the key is the line stripped of ASCII blanks with A-Z lower-cased, and only keys of
    ``min_chars`` code points or more count. Kept lines are joined again in order of position. All columns stay, ``text_col`` is
    replaced and a struct ``out`` (n_lines before dropping, n_dropped) is added in place of any column of that name.

    Null or empty text is one empty line. Rows sharing an id are one document: a line counts once for them, and each of these rows
    keeps or loses it alike. A null id is a document of its own, smaller than all others. An empty table gives an empty one.
    Hot lines are pre-aggregated before both shuffles; only positions, never texts, are grouped by line.
    """
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    keyed = docs.select(did.alias("d"), F.xxhash64(text_col).alias("t"), _keys(F.col(text_col), min_chars).alias("k"))
    once = keyed.select("d", F.explode(F.array_distinct(F.filter("k", lambda x: x.isNotNull()))).alias("x")).select("d", "x.h", "x.g")
    repeated = (once.distinct().groupBy("h", "g").agg(F.count("*").alias("n"), F.max("d").alias("keeper"))
                .filter(F.col("n") >= min_docs).select("h", "g", "keeper"))
    places = keyed.select("d", "t", F.posexplode("k").alias("pos", "x")).filter("x IS NOT NULL").select("d", "t", "pos", "x.h", "x.g")
    lost = (places.join(repeated, ["h", "g"]).filter(F.col("d") != F.col("keeper"))
            .groupBy("d", "t").agg(F.collect_set("pos").alias("__lost")))
    src = docs.withColumns({"__d": did, "__t": F.xxhash64(text_col)})
    joined = src.join(lost, (src["__d"] == lost["d"]) & (src["__t"] == lost["t"]), "left").withColumns({
        "__lines": F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1),
        "__lost": F.coalesce("__lost", F.array().cast("array<int>"))})
    places_kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    text = F.when(F.size("__lost") == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(places_kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    record = F.struct(F.size("__lines").cast("long").alias("n_lines"), F.size("__lost").cast("long").alias("n_dropped"))
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    return joined.select(*[text.alias(c) if c == text_col else src[c] for c in keep], record.alias(out))

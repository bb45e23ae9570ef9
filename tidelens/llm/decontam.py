"""Benchmark decontamination with a positional inverted index over the rarest terms of every benchmark window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelens.llm.native import NO_ID, ascii_lower, store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what is left of ASCII besides digits and small letters
END = ""  # a term after the last word: its position is the number of words
SMALL_TERMS = 1_000_000  # terms up to which a term table is broadcast


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def windows(bench: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item, phrase, size): each run of ``width`` words of an item; an item of fewer words, but not none, is one window."""
    items = bench.select(F.col(item_col).alias("item"), word_array(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("w")).select(
        "item", F.array_join("w", " ").alias("phrase"), F.size("w").alias("size")).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_TERMS else df


class Index:
    """Postings of the terms that the windows of a benchmark are looked up by.

    Of each window the ``rarest`` terms, by number of documents in the corpus, are its anchors; a window with a term that no
    document has is left out. Postings hold document, position and the words around the positions of first anchors.
    """

    def __init__(self, docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 bench_text_col: str = "text", width: int = 13, rarest: int = 2) -> None:
        base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text_col).alias("t"), word_array(F.col(text_col)).alias("w"))
        self.windows = store(windows(bench, width, item_col, bench_text_col))
        phrases = self.windows.select("phrase", "size").distinct()
        terms = phrases.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
        vocabulary = store(terms.select("term").distinct())
        held = base.select(F.explode(F.array_distinct("w")).alias("term")).join(_small(vocabulary), "term")
        counts = store(held.groupBy("term").agg(F.count("*").alias("df")))
        order = Window.partitionBy("phrase").orderBy(F.col("df").asc_nulls_first(), "term", "off")
        ranked = terms.join(counts, "term", "left").withColumn("rank", F.row_number().over(order)).withColumn("least", F.first("df").over(order))
        self.anchors = store(ranked.filter(F.col("least").isNotNull() & (F.col("rank") <= rarest)).select("phrase", "size", "off", "term", "rank"))
        first = F.col("rank") == 1
        roles = self.anchors.groupBy("term").agg(F.max(F.when(first, F.col("off"))).alias("ahead"), F.max(F.when(first, F.col("size") - F.col("off"))).alias("after"))
        end = roles.sparkSession.createDataFrame([(END, None, None)], roles.schema)
        wanted = _small(store(roles.union(end)))
        spots = base.select("d", "t", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "term")).join(wanted, "term")
        begin = F.greatest(F.col("pos") - F.col("ahead"), F.lit(0))
        around = F.when(F.col("ahead").isNotNull(), F.slice("w", begin + 1, F.col("pos") + F.col("after") - begin))
        self.postings = store(spots.select("d", "t", "pos", "term", begin.alias("begin"), around.alias("around")))
        self.documents = self.postings.filter(F.col("term") == END).select("d", "t", F.col("pos").cast("long").alias("n_words"))

    def _offsets(self) -> DataFrame:
        """Postings moved to where the window would start."""
        found = self.postings.filter(F.col("term") != END).join(self.anchors, "term")
        return found.withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")

    def phrases(self) -> DataFrame:
        """(d, t, phrase, size, start): whole windows, word for word. Their anchors' lists meet at one start, then the words are compared."""
        moved = self._offsets()
        words = F.slice("around", F.col("start") - F.col("begin") + 1, F.col("size"))
        lead = moved.filter("rank = 1").filter(F.array_join(words, " ") == F.col("phrase")).select("d", "t", "phrase", "size", "start")
        rest = moved.filter("rank > 1").select("d", "t", "phrase", "start").distinct()
        both = lead.join(rest, ["d", "t", "phrase", "start"], "left_semi").filter("size > 1")
        return lead.filter("size = 1").unionByName(both).distinct()

    def near(self, slop: int = 5) -> DataFrame:
        """(d, t, phrase, start, gap): the two rarest terms of a window at most ``slop`` words away from their exact distance."""
        moved = self._offsets().select("d", "t", "phrase", "start", "rank")
        step = slop + 1
        lead = moved.filter("rank = 1").withColumn("cell", F.floor(F.col("start") / step))
        rest = moved.filter("rank = 2").select("d", "t", "phrase", F.col("start").alias("other"), F.explode(F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("start") / step) + k)).alias("cell"))
        return lead.join(rest, ["d", "t", "phrase", "cell"]).withColumn("gap", F.abs(F.col("other") - F.col("start"))).filter(F.col("gap") <= slop).groupBy(
            "d", "t", "phrase", "start").agg(F.min("gap").alias("gap"))


def leak_report(index: Index, share: int = 20) -> DataFrame:
    """One row per document row: d, t, n_words, n_hit, items (sorted ids as strings), contaminated (share * n_hit >= n_words > 0)."""
    hits = store(index.phrases())
    spots = hits.select("d", "t", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).distinct()
    counts = spots.groupBy("d", "t").agg(F.count("*").alias("n_hit"))
    items = hits.join(index.windows.select("item", "phrase"), "phrase").select("d", "t", F.col("item").cast("string").alias("item")).distinct().groupBy("d", "t").agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    out = index.documents.join(counts.join(items, ["d", "t"], "left"), ["d", "t"], "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def scan(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated of every document row.

    Words are runs of digits, letters and bytes beyond ASCII, A-Z lower-cased. A word inside any occurrence of a benchmark window is
    hit. Null or empty texts have no words and no hit; an empty benchmark hits nothing. Rows that share an id are judged row by row;
    a null item id counts for hits but is in no list. Only two columns of ``docs`` are read, so further ones cannot clash.
    """
    out = leak_report(Index(docs, bench, **how))
    return out.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_words", "n_hit", "items", "contaminated")


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = leak_report(Index(docs, bench, id_col, text_col, **how)).filter("contaminated").select(F.col("d").alias("__d"), F.col("t").alias("__t"))
    keyed = docs.withColumns({"__d": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__t": F.xxhash64(text_col)})
    return keyed.join(bad, ["__d", "__t"], "left_anti").select(*docs.columns)

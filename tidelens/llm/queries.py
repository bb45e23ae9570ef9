"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelens.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op8_flow_mixing", oracles.MIXING)
def flow_mixing(spark: SparkSession, root: str) -> DataFrame:
    """All documents, one source each, mixed to the targets of ``share_targets``."""
    from tidelens.llm.mixing import count_words, mix

    out = mix(table(spark, root, "documents"), F.array("source"), count_words(F.col("text")))
    return out.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("source_targets", F.lit(0)).alias("target"), "taken")


@query("op9_line_dedup", oracles.LINES)
def line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Lines of at least 20 code points found in at least 3 documents stay in the largest doc_id only."""
    from tidelens.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, root, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_quality")
def quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    from tidelens.llm.native import crc_remainder
    from tidelens.llm.quality import fit, score_quality

    docs = table(spark, root, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, root, "labels"), learn=crc_remainder(F.col("doc_id"), 5) != 0)
    out = score_quality(docs, model, out="score")
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_ngram_join")
def ngram_join(spark: SparkSession, root: str) -> DataFrame:
    """Documents linked by 4-word shingles with a Jaccard similarity of at least 85 / 100."""
    from tidelens.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, root, "documents"), n=4, num=85, den=100)


@query("op6_decontamination", oracles.LEAKS)
def decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items."""
    from tidelens.llm.decontam import scan

    out = scan(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_suffix_tree")
def suffix_tree(spark: SparkSession, root: str) -> DataFrame:
    """log10 probability of every document under a suffix tree learnt outside one fold."""
    from tidelens.llm.native import crc_remainder
    from tidelens.llm.suffix_tree import score_texts

    docs = table(spark, root, "documents")
    out = score_texts(docs, crc_remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_warc_zip", oracles.WARC)
def warc_zip(spark: SparkSession, root: str) -> DataFrame:
    """All pages as WARC records in ZIP archives, read back by range."""
    from tidelens.llm.native import NO_ID
    from tidelens.llm.warc_zip import archive_pages

    out = archive_pages(table(spark, root, "pages").select("page_id", "url", "html"))
    restore = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(restore("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", restore("refers_to").alias("refers_to"))


@query("op1_cover_tree")
def cover_tree(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings of an equal label with a cosine of at least 0.98."""
    from tidelens.llm.cover_tree import near_pairs

    return near_pairs(table(spark, root, "embeddings"), block=F.col("label"))


@query("op2_chat_tree", oracles.CHAT)
def chat_tree(spark: SparkSession, root: str) -> DataFrame:
    """All conversations and one with control strings, formatted as packed prefix trees and read back."""
    from tidelens.llm.chat_tree import round_trip

    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return round_trip(turns.unionByName(extra))


@query("op4_licences", oracles.LICENCES)
def licences(spark: SparkSession, root: str) -> DataFrame:
    """Licences of all documents laid out as files.

    A document is the file source/language/thousands/id.txt. Every tenth one is not: it is the file LICENSE-id of one of the three
    directories above it, by its id, and speaks for that directory if any of its lines states a licence."""
    from tidelens.llm.licences import scan

    docs, i = table(spark, root, "documents"), F.col("doc_id")
    dirs = F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(i / 1000).cast("string"))
    home = F.array_join(F.slice(dirs, F.lit(1), F.when(i % 10 == 0, F.floor(i / 10) % 3 + 1).otherwise(3).cast("int")), "/")
    path = F.concat(home, F.when(i % 10 == 0, F.concat(F.lit("/LICENSE-"), i)).otherwise(F.concat(F.lit("/"), i, F.lit(".txt"))))
    out = scan(docs.select(path.alias("path"), "text"))
    return out.select(F.regexp_extract("path", r"(\d+)(\.txt)?$", 1).cast("long").alias("doc_id"), "path", "own", F.round("own_cosine", 6).alias("own_cosine"), "n_lines", "inherited", "from_dir", "licence")


@query("op13_repair", oracles.REPAIR)
def conversation_repair(spark: SparkSession, root: str) -> DataFrame:
    """Conversations damaged by a checksum of their rows, and their cheapest repair."""
    from tidelens.llm.repair import damage, repair

    return repair(table(spark, root, "conversations"), prepare=damage)


@query("op11_vector_codes", oracles.CODES)
def vector_codes(spark: SparkSession, root: str) -> DataFrame:
    """Codes of all embeddings under codebooks trained on all of them."""
    from tidelens.llm.vector_codes import compress

    return compress(table(spark, root, "embeddings"))


@query("op12_main_text", oracles.MAIN_TEXT)
def main_text(spark: SparkSession, root: str) -> DataFrame:
    """The article of every page."""
    from tidelens.llm.main_text import extract

    return extract(table(spark, root, "pages"))

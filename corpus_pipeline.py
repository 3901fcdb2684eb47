"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of ``documents``. Rows with null or empty texts fail the quality rules. Columns other than
those of ``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import neardup, packing, quality, repeats, substrings
from millrace.llm.queries import table
from millrace.llm.tables import identified, keep, kept_so_far, release
from millrace.sources import new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a rule nor the likelihood ratio rejects; a row alone is judged by its text."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, "doc_id", "text", table(spark, sf_dir, "labels"), F.col("quality") == 1)
    keep = {c: F.col(c) for c in COLUMNS if c != "text"} | {"body": F.col("text")}
    return quality.judge(docs, keep, "text", model).filter("kept").withColumnRenamed("body", "text").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id: shingles of five words, a similarity of 0.8 or more. Rows without a doc_id, or with a shared one, are judged by their texts like all others."""
    rows = identified(docs, key=F.col("doc_id"), text=F.col("text"), more=F.struct("lang", "source", "n_chars"))
    # The dropped rows are the smaller part; only rows that may be among them are shuffled with their texts.
    dropped = neardup.resolve(rows.select("key", "tie", "text"), 5, 80).filter("NOT kept").select("key", "tie", F.lit(1).alias("items"))
    inside = repeats.join_lists(rows, keep(dropped.withColumn("id", repeats.text_key()), "dropped")).filter("items IS NULL")
    return inside.select(F.col("key").alias("doc_id"), "text", "more.*").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of twenty words or more that start earlier go out of the texts; every document stays, and ``n_chars`` follows."""
    out = substrings.remove_repeats(docs.select(*COLUMNS), "doc_id", "text", 20, ["lang", "source"])
    text = F.col("kept_text")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row per piece of a document."""
    cut = packing.token_pieces(docs.select("doc_id", "text"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 2, 4096)
    return packing.pack(cut, "length", 4096)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL has no SuperMinHash, union-find or tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path, before = new_path(spark, name), kept_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

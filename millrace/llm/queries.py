"""One query per operator over the whole of its table, with production parameters."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, centroids, fingerprints, neardup, packing, phrases, quality, sharding, substrings, suffixes, token_counts, token_files, urls
from millrace.llm.oracles import ORACLE
from millrace.llm.tables import small_batches

#: The columns that the operators read; the tables may have more.
SCHEMAS = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "pages": "page_id bigint, url string", "labels": "doc_id bigint, quality int, toxic int", "embeddings": "vec_id bigint, embedding array<float>"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(table(spark, d, "documents"), "doc_id", "text", tokenizer), "ids", tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, d, "documents"), "doc_id", "text").drop("tie")


def op3_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"), "doc_id", "text", 4, 80)


def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    cut = packing.token_pieces(table(spark, d, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 2, 4096)
    return packing.pack(cut, "length", 4096)


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sizes = {"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text)}
    out = sharding.shard(table(spark, d, "documents"), "doc_id", 40, sizes)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_suffixes(spark: SparkSession, d: str) -> DataFrame:
    out = suffixes.remove_strings(table(spark, d, "documents"), "doc_id", "text", 200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit(docs, "doc_id", "text", table(spark, d, "labels"), F.col("quality") == 1)
    out = quality.judge(docs, {"doc_id": F.col("doc_id")}, "text", model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_token_files(spark: SparkSession, d: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, d, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 0)
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", token_files.token_crc().alias("ids_crc32"))


def op9_substrings(spark: SparkSession, d: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, d, "documents"), "doc_id", "text", 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_words", "UTF-8"), 256).alias("kept_sha256"))


#: The rules of the query.
URL_RULES = [
    urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("example.org/en/1", "block"),
    urls.Rule("com/fr/", "allow"), urls.Rule("com/de/", "block"),
]


def op10_url_filters(spark: SparkSession, d: str) -> DataFrame:
    out = urls.judge_urls(table(spark, d, "pages"), "page_id", "url", URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op11_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(table(spark, d, "documents"), "lang", "text", 100, 5, 2000, "und")


def op12_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, d, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op13_centroids(spark: SparkSession, d: str) -> DataFrame:
    assigned, found = centroids.cluster(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 8, 10, 1024, 3)
    return centroids.with_inertia(assigned, found)


def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts and the base rules of op7, which SQL can say."""
    none = quality.LikelihoodRatio(np.zeros(1 << quality.BITS), 0.0)
    out = quality.judge(table(spark, d, "documents"), {"doc_id": F.col("doc_id")}, "text", none)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, d: str) -> DataFrame:
    """Host, path and rule of op10, and the verdict of the rule, which SQL can say."""
    host, path = urls.host_and_path(F.col("url"))
    rule, verdict = urls.apply_rules(host, path, URL_RULES)
    return table(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("by_rule"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_near_duplicates, op4_packing, op5_sharding, op6_suffixes, op7_quality, op8_token_files, op9_substrings, op10_url_filters, op11_phrases, op12_token_counts, op13_centroids, quality_counts, url_rules)}

__all__ = ["ORACLE", "QUERIES", "table"]

"""The queries of this subpackage: opN_<name> applies operator N to its whole table; pipeline runs corpus_pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table

JSON_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents"), "doc_id", "text", RANK_VOCAB, PATTERN).withColumnRenamed("id", "doc_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digests

    return bpe_digests(read_table(spark, sf_dir, "documents"), "doc_id", "text", JSON_VOCAB, PATTERN).withColumnRenamed("id", "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, word_count

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix(docs, "doc_id", "source", F.col("words"))
    return mixed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__taken").alias("taken")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    return dedup_substrings(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digests, with_probe

    return conversation_digests(with_probe(read_table(spark, sf_dir, "conversations")))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_fingerprints

    return edited_fingerprints(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "doc_id", "text")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (
        op1_suffix_dedup, op2_chat_format, op3_secret_scans, op4_bpe, op5_mixing, op6_quality_rules, op7_minhash_dedup, op8_fingerprints,
        op9_toxicity, op10_html_text, pipeline
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)

"""A corpus pipeline of five stages; each takes what the one before it kept and returns the columns of documents, the last token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foresail.llm.bpe import bpe_encode
from foresail.llm.common import Scratch, join_few, read_table, small_batches
from foresail.llm.minhash import near_duplicates
from foresail.llm.mixing import mix, word_count
from foresail.llm.quality import keep_good
from foresail.llm.queries import JSON_VOCAB, PATTERN, RANK_VOCAB
from foresail.llm.secret_scan import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's rate reject go, those of null or empty texts among them. Repeated rows and ids are judged each for itself."""
    small_batches(spark)
    return keep_good(docs.select(*COLUMNS), "text", "source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id, a null one before all, then the smaller hash of the text.

    Rows that repeat id and text are one document and stay once, with the other columns of one of them. Documents without words stay.
    """
    small_batches(spark)
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    rows = docs.select(*COLUMNS).withColumn("__row", own)
    work = Scratch(spark, "pipeline")
    verdicts = near_duplicates(rows, "__row", "text").groupBy("__row").agg(F.max("kept").alias("kept"), F.count("*").alias("c"))
    # the rows that go or stay once, fewer than those that simply stay: broadcast after a count, so that texts are shuffled only if they are many
    odd = work.save(verdicts.where("NOT kept OR c > 1"), "odd")
    single = join_few(rows, odd.select("__row"), "__row", "doc_id", "left_anti")
    again = work.save(odd.where("kept").select("__row"), "again")
    if not again.isEmpty():
        single = single.unionByName(join_few(rows, again, "__row", "doc_id", "left_semi").dropDuplicates(["__row"]))
    return single.select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. Null and empty texts stay as they are, each row for itself."""
    small_batches(spark)
    return redact_secrets(docs.select(*COLUMNS), "text", RANK_VOCAB, PATTERN).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it whole. Documents without words are taken no times; rows that tie in size, source and id
    are ordered by their text, so that reruns agree."""
    rows = docs.select(*COLUMNS).withColumn("__id", F.struct(F.col("doc_id"), F.xxhash64("text")))
    mixed = mix(rows, "__id", "source", word_count(F.col("text")), part_copies=False)
    return mixed.where("__copies > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row, copies too; no tokens for a null or empty text."""
    small_batches(spark)
    coded = bpe_encode(docs, "doc_id", "text", JSON_VOCAB, PATTERN, decode=False)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("secret scans", secrets), ("mixing", mixture), ("tokens", tokens)]

#: Entropy balancing and tokenizing can't be put in SQL; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what each stage returns is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    work = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), str(i))
        if i:
            work.drop(str(i - 1))
    return docs

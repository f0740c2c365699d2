"""Prefix lexicons: words with counts, and an index of prefixes in place of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def words_of_counts(counts: DataFrame) -> DataFrame:
    """(word, cnt) with counts of equal words added; empty words are ignored."""
    return counts.where("word <> ''").groupBy("word").agg(F.sum("cnt").alias("cnt"))


def prefixes(words: DataFrame) -> DataFrame:
    """(prefix, word, cnt) for each prefix of each word, the empty one too."""
    return words.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("prefix"), "word", "cnt"
    )


def lookup(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, is_word, cnt, has_prefix) of asked strings."""
    own = words.select(F.col("word").alias("asked"), "cnt")
    inner = asked.join(prefixes(words).select(F.col("prefix").alias("asked"), F.lit(True).alias("p")).distinct(), "asked", "left")
    return inner.join(own, "asked", "left").select(
        "asked", F.col("cnt").isNotNull().alias("is_word"), F.coalesce("cnt", F.lit(0)).alias("cnt"),
        F.coalesce("p", F.lit(False)).alias("has_prefix")
    )


def words_with_prefix(words: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.select(F.col("asked").alias("prefix")).distinct().join(prefixes(words), "prefix").select("prefix", "word", "cnt")


def complete(words: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(prefix, rank, word, cnt): the k most frequent words of each prefix, ties by word."""
    w = Window.partitionBy("prefix").orderBy(F.col("cnt").desc(), "word")
    return words_with_prefix(words, asked).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def node_count(words: DataFrame) -> DataFrame:
    """Distinct prefixes, the root included."""
    return prefixes(words).select("prefix").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("nodes"))

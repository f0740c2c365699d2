"""User profiles: the retained suffix of each user's sentences, their n-gram counts, backoff scores and completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, EngineConfig
from .lm import rank_key


def observed(sents: DataFrame) -> DataFrame:
    """(user, seq, tokens): lower-cased, without empty tokens or sentences."""
    t = F.filter(F.transform("tokens", lambda t: F.lower(t)), lambda t: t != "")
    return sents.select("user", "seq", t.alias("tokens")).where(F.size("tokens") > 0)


def retained(obs: DataFrame, cap: int) -> DataFrame:
    """The longest suffix of each user's sentences with at most cap tokens: what evicting the oldest on each arrival leaves."""
    w = Window.partitionBy("user").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return obs.withColumn("s", F.sum(F.size("tokens")).over(w)).where(F.col("s") <= cap).drop("s")


def weight(tokens: Column, cfg: EngineConfig = DEFAULT) -> Column:
    if not cfg.growth_tokens:
        return F.lit(cfg.lambda_max)
    return cfg.lambda_max * F.least(F.lit(1.0), tokens / float(cfg.growth_tokens))


def stats(obs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(user, tokens, sentences, vocabulary, weight); the vocabulary is of all that was ever observed."""
    kept = retained(obs, cfg.profile_cap).groupBy("user").agg(F.sum(F.size("tokens")).alias("tokens"), F.count("*").alias("sentences"))
    vocab = obs.select("user", F.explode("tokens").alias("w")).groupBy("user").agg(F.count_distinct("w").alias("vocabulary"))
    out = vocab.join(kept, "user", "left").select(
        "user", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce("sentences", F.lit(0)).alias("sentences"), "vocabulary"
    )
    return out.withColumn("weight", weight(F.col("tokens"), cfg))


def user_grams(kept: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(user, k, ctx, word, cnt, first_seen) over the retained sentences."""
    from ..functions.text import pad

    n = cfg.order
    p = kept.select("user", F.col("seq").alias("sid"), pad(F.col("tokens"), n, cfg.bos, cfg.eos).alias("p"))
    p = p.select("user", "sid", "p", F.explode(F.sequence(F.lit(n), F.size("p"))).alias("i"))
    parts = []
    for k in range(1, n + 1):
        ctx = F.slice("p", F.col("i") - (k - 1), k - 1) if k > 1 else F.array().cast("array<string>")
        parts.append(
            p.select("user", F.lit(k).alias("k"), ctx.alias("ctx"), F.get("p", F.col("i") - 1).alias("word"), "sid", (F.col("i") - n).alias("pos"))
        )
    return reduce(DataFrame.unionByName, parts).groupBy("user", "k", "ctx", "word").agg(
        F.count("*").alias("cnt"), F.min(F.struct("sid", "pos")).alias("first_seen")
    )


def user_prob(asked: DataFrame, grams: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """asked (user, ctx of order - 1, word, anything) with p_user: stupid backoff, 0 for what the user never wrote."""
    n, rows = cfg.order, asked
    out = F.lit(0.0)
    for k in range(1, n + 1):
        g = grams.where(f"k = {k}")
        c = F.slice("ctx", F.lit(n - k + 1), F.lit(k - 1)) if k > 1 else F.array().cast("array<string>")
        t = g.groupBy("user", "ctx").agg(F.sum("cnt").alias(f"t{k}")).withColumnRenamed("ctx", "__c")
        rows = rows.withColumn("__c", F.transform(c, lambda x: F.lower(x))).join(
            g.select("user", F.col("ctx").alias("__c"), "word", F.col("cnt").alias(f"n{k}")), ["user", "__c", "word"], "left"
        ).join(t, ["user", "__c"], "left").drop("__c")
        out = F.when(F.coalesce(f"n{k}", F.lit(0)) > 0, cfg.backoff_alpha ** (n - k) * F.col(f"n{k}") / F.col(f"t{k}")).otherwise(out)
    return rows.select(*[F.col(c) for c in asked.columns], out.alias("p_user"))


def user_candidates(asked: DataFrame, grams: DataFrame, k: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(user, ctx, rank, word, p_user): the k best words that the user wrote after some suffix of the context.

    A word scores by the longest suffix it follows, so its own gram gives the score. Words of the empty context come by rank: with m words
    from longer suffixes, the k + m most frequent ones hold all that can be among the best k.
    """
    n, empty = cfg.order, F.array().cast("array<string>")
    g = grams.where(~F.col("word").isin(cfg.bos, cfg.eos))
    totals = grams.groupBy("user", "k", "ctx").agg(F.sum("cnt").alias("t"))
    g = g.join(totals, ["user", "k", "ctx"]).withColumn("p", F.col("cnt") / F.col("t"))
    a = asked.select("user", "ctx").distinct()
    parts = []
    for o in range(n, 1, -1):
        c = F.transform(F.slice("ctx", F.lit(n - o + 1), F.lit(o - 1)), lambda x: F.lower(x))
        own = g.where(f"k = {o}").select(
            "user", F.col("ctx").alias("__c"), "word", F.lit(o).alias("o"), (cfg.backoff_alpha ** (n - o) * F.col("p")).alias("p_user")
        )
        parts.append(a.withColumn("__c", c).join(own, ["user", "__c"]).select("user", "ctx", "word", "o", "p_user"))
    none = a.select("user", "ctx", F.lit(None).cast("string").alias("word"), F.lit(0).alias("o"), F.lit(None).cast("double").alias("p_user")).limit(0)
    higher = reduce(DataFrame.unionByName, parts, none).groupBy("user", "ctx", "word").agg(
        F.max_by("p_user", "o").alias("p_user"), F.max("o").alias("o")
    )
    m = a.join(higher.groupBy("user", "ctx").agg(F.count("*").alias("m")), ["user", "ctx"], "left")
    places = m.select("user", "ctx", F.explode(F.sequence(F.lit(1), F.coalesce("m", F.lit(0)).cast("int") + k)).alias("place"))
    w = Window.partitionBy("user").orderBy(F.col("cnt").desc(), "word")
    single = g.where("k = 1").withColumn("place", F.row_number().over(w)).select(
        "user", "place", "word", (cfg.backoff_alpha ** (n - 1) * F.col("p")).alias("p_user")
    )
    low = places.join(single, ["user", "place"]).select("user", "ctx", "word", F.lit(1).alias("o"), "p_user")
    all_ = higher.unionByName(low).groupBy("user", "ctx", "word").agg(F.max_by("p_user", "o").alias("p_user"))
    w = Window.partitionBy("user", "ctx").orderBy(rank_key(F.col("p_user")).desc(), "word")
    return all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user", "ctx", "rank", "word", "p_user")


def user_words(obs: DataFrame) -> DataFrame:
    return obs.select("user", F.explode("tokens").alias("word")).groupBy("user", "word").agg(F.count("*").alias("cnt"))

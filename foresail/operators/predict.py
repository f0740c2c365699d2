"""Suggestions: candidates of a model and of users, blended, reranked by tags, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from . import lexicon, profile as P
from .hmm import HMMTagger
from ..sources.bundle import materialize
from .lm import NgramModel, rank_key


def requests_from_buffers(buffers: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(req_id, user, ctx, prefix) from (req_id, user, buffer); contexts are padded to order - 1."""
    tail, prefix = T.split_buffer(F.col("buffer"), cfg.order)
    n = cfg.order - 1
    ctx = F.transform(tail, lambda t: F.lower(t))
    padded = F.concat(F.array_repeat(F.lit(cfg.bos), n), ctx)
    return buffers.select("req_id", "user", F.slice(padded, F.size(padded) - n + 1, n).alias("ctx"), F.lower(prefix).alias("prefix"))


class Predictor:
    def __init__(
        self, model: NgramModel, words: DataFrame, truecase: DataFrame | None = None, grams: DataFrame | None = None,
        user_words: DataFrame | None = None, user_stats: DataFrame | None = None, tagger: HMMTagger | None = None, cfg: EngineConfig = DEFAULT
    ):
        self.model, self.words, self.truecase, self.cfg = model, words, truecase, cfg
        self.grams, self.user_words, self.user_stats, self.tagger = grams, user_words, user_stats, tagger

    def candidates(self, req: DataFrame) -> DataFrame:
        """(req_id, user, ctx, prefix, mode, word, base): the pool of each request, from the model and, if there is one, the user's profile.

        base is the model's score where the search for next words has it already, else null.
        """
        cfg = self.cfg
        typed = req.where((F.col("prefix") != "") & (F.length("prefix") >= cfg.min_prefix_len)).withColumn("mode", F.lit("completion"))
        nextw = req.where("prefix = ''").withColumn("mode", F.lit("next_word"))
        cols = ("req_id", "user", "ctx", "prefix", "mode", "word", "base")
        unscored = F.lit(None).cast("double").alias("base")
        asked = typed.select(F.col("prefix").alias("asked")).distinct()
        done = lexicon.complete(self.words, asked, cfg.pool).select("prefix", "word")
        a = typed.join(done, "prefix").withColumn("base", unscored).select(*cols)
        words = self.model.candidates(nextw.select("ctx").distinct(), cfg.pool).select("ctx", "word", F.col("score").alias("base"))
        out = a.unionByName(nextw.join(words, "ctx").select(*cols))
        if self.grams is not None:
            mine = P.user_candidates(nextw, self.grams, cfg.pool, cfg).select("user", "ctx", "word", unscored)
            out = out.unionByName(nextw.join(mine, ["user", "ctx"]).select(*cols))
            # only prefixes that are asked for: a user's words meet them by their first characters
            lens = typed.select("user", F.length("prefix").alias("n")).distinct()
            pre = self.user_words.join(lens, "user").where(F.length("word") >= F.col("n"))
            pre = pre.select("user", F.substring("word", F.lit(1), F.col("n")).alias("prefix"), "word", "cnt")
            pre = pre.join(typed.select("user", "prefix").distinct(), ["user", "prefix"])
            w = Window.partitionBy("user", "prefix").orderBy(F.col("cnt").desc(), "word")
            mine = pre.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cfg.pool).withColumn("base", unscored)
            out = out.unionByName(typed.join(mine, ["user", "prefix"]).select(*cols))
        out = out.where(~((F.col("mode") == "next_word") & F.col("word").isin(cfg.bos, cfg.eos, cfg.unk)))
        if self.grams is not None:
            out = out.groupBy(*cols[:-1]).agg(F.max("base").alias("base"))
        return out if cfg.suggest_punctuation else out.where(~F.col("word").rlike(T.PUNCTUATION))

    def scored(self, req: DataFrame) -> DataFrame:
        """The candidates with base, of_user, lam, score and shown, and with a tagger tag, known, ctx_tag and pos."""
        cfg, m = self.cfg, self.cfg.smoothing
        c = self.candidates(req).withColumn("base", F.col("base") if m == "stupid_backoff" else F.lit(None).cast("double"))
        c = materialize(c)
        open_ = c.where("base IS NULL").drop("base")
        pairs = self.model.score(open_.select("ctx", "word").distinct(), (m,)).withColumnRenamed(f"p_{m}", "base")
        c = c.where("base IS NOT NULL").unionByName(open_.join(pairs, ["ctx", "word"]))
        if self.grams is not None:
            c = P.user_prob(c, self.grams, cfg).withColumnRenamed("p_user", "of_user")
            lam = self.user_stats.select("user", F.col("weight").alias("lam"))
            c = c.join(lam, "user", "left").withColumn("lam", F.coalesce("lam", F.lit(0.0)))
        else:
            c = c.withColumn("of_user", F.lit(0.0)).withColumn("lam", F.lit(0.0))
        c = c.withColumn("score", F.col("lam") * F.col("of_user") + (1.0 - F.col("lam")) * F.col("base"))
        if self.truecase is not None:
            forms = self.truecase.select(F.col("lower").alias("word"), "surface")
            c = c.join(forms, "word", "left").withColumn("shown", F.coalesce("surface", "word")).drop("surface")
        else:
            c = c.withColumn("shown", F.col("word"))
        if self.tagger is None:
            return c.withColumn("tag", F.lit(None).cast("string")).withColumn("pos", F.lit(0.0))
        c = materialize(c)
        tags = self.typical_tags(c.select("word").distinct())
        prev = self.context_tags(c.select("ctx").distinct())
        c = c.join(tags, "word").join(prev, "ctx", "left")
        return c.withColumn("pos", self.tag_score(F.col("tag"), F.col("ctx_tag"), F.col("known")))

    def final(self, alpha=None) -> Column:
        """The score, or with a tagger the reranked logarithm; alpha is a number or a column."""
        if self.tagger is None:
            return F.col("score")
        alpha = F.lit(self.cfg.rerank_alpha) if alpha is None else alpha
        return F.when(F.col("score") > 0, F.ln("score")).otherwise(F.lit(self.cfg.score_floor)) + alpha * F.col("pos")

    def rank(self, scored: DataFrame, k: int | None = None, by: tuple[str, ...] = ("req_id",)) -> DataFrame:
        """The k best of each request with rank and final; scored may bring its own final."""
        if "final" not in scored.columns:
            scored = scored.withColumn("final", self.final())
        key = rank_key(F.col("final")) if self.tagger is None else F.round("final", 9)
        w = Window.partitionBy(*by).orderBy(key.desc(), "shown")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (k or self.cfg.suggestions))

    def predict(self, req: DataFrame, k: int | None = None) -> DataFrame:
        """(req_id, rank, word, score, source, mode, tag)."""
        r = self.rank(self.scored(req), k)
        source = F.when(F.col("of_user") > 0, "user").otherwise("base")
        return r.select("req_id", "rank", F.col("shown").alias("word"), F.col("final").alias("score"), source.alias("source"), "mode", "tag")

    def learn(self, profiles, texts: DataFrame) -> DataFrame:
        """Feed accepted or typed texts (user, seq, text) back into a stored set of profiles; (user, tokens) that were added."""
        return profiles.observe_texts(texts)

    # tags

    def typical_tags(self, words: DataFrame) -> DataFrame:
        """(word, tag, known): the best tag of a word out of context."""
        t = self.tagger
        e = t.with_emissions(words.select(F.lit(0).cast("bigint").alias("sid"), F.lit(1).alias("pos"), "word"))
        post = F.zip_with("emit", F.array(*map(F.lit, t.log_prior)), lambda a, b: a + b)
        e = e.withColumn("post", post)
        return e.select(
            "word", F.get(F.array(*map(F.lit, t.tags)), (F.array_position("post", F.array_max("post")) - 1).cast("int")).alias("tag"), "known"
        )

    def context_tags(self, contexts: DataFrame, window: int | None = None) -> DataFrame:
        """(ctx, ctx_tag): the tag of the last token, by decoding the window before it; null without context."""
        cfg, t = self.cfg, self.tagger
        n = cfg.tag_window if window is None else window
        real = F.filter("ctx", lambda w: w != cfg.bos)
        own = contexts.withColumn("real", real).withColumn("win", F.slice("real", F.greatest(F.size("real") - n + 1, F.lit(1)), F.lit(n)))
        own = own.withColumn("sid", F.concat_ws("\u0001", "win"))
        wins = own.where(F.size("win") > 0).select("win", "sid").distinct()
        tags = t.last_tags(wins.select("sid", F.posexplode("win").alias("pos", "word"))).withColumnRenamed("tag", "ctx_tag")
        return own.join(tags, "sid", "left").select("ctx", "ctx_tag")

    def tag_score(self, tag: Column, prev: Column, known: Column) -> Column:
        t = self.tagger
        ix = F.create_map(*[x for i, n in enumerate(t.tags) for x in (F.lit(n), F.lit(i))])
        flat = F.array(*[F.lit(x) for row in t.log_transition for x in row])
        s = F.when(
            prev.isNull(), F.get(F.array(*map(F.lit, t.log_initial)), F.element_at(ix, tag))
        ).otherwise(F.get(flat, F.try_element_at(ix, prev) * len(t.tags) + F.element_at(ix, tag)))
        return s + F.when(known, 0.0).otherwise(self.cfg.unknown_tag_penalty)

    # evaluation

    def hit_at_k(self, asked: DataFrame, ks=(1, 3, 5), alphas: tuple[float, ...] = ()) -> DataFrame:
        """(positions, hit_<k>) of asked (ctx, prefix, target); equal requests are predicted once, and alphas are rows of one scored table."""
        req = asked.select("ctx", "prefix").distinct().withColumn("req_id", F.struct("ctx", "prefix")).withColumn("user", F.lit(None).cast("bigint"))
        s, by = self.scored(req), ()
        if alphas:
            s, by = s.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))), ("alpha",)
            s = s.withColumn("final", self.final(F.col("alpha")))
        r = self.rank(s, max(ks), (*by, "req_id")).select(*by, "ctx", "prefix", F.lower("shown").alias("target"), "rank")
        best = r.groupBy("ctx", "prefix", "target", *by).agg(F.min("rank").alias("rank"))
        rows = asked.groupBy("ctx", "prefix", "target").agg(F.count("*").alias("n"))
        if alphas:
            rows = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
        rows = rows.join(best, ["ctx", "prefix", "target", *by], "left")
        div = lambda a: F.coalesce(F.try_divide(a, F.sum("n")), F.lit(0.0))
        hits = [div(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0))).alias(f"hit_{k}") for k in ks]
        return rows.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("positions"), *hits)

    def keystroke_savings(self, asked: DataFrame, k: int | None = None) -> DataFrame:
        """(words, baseline, cost, accepted, savings) of asked (ctx, target): each word costs the shortest prefix that shows it and one key."""
        cfg = self.cfg
        n = asked.groupBy("ctx", "target").agg(F.count("*").alias("n"))
        lens = F.explode(F.sequence(F.lit(cfg.min_prefix_len), F.length("target") - 1))
        tries = n.where(F.length("target") > cfg.min_prefix_len).select("ctx", "target", lens.alias("p"))
        tries = tries.withColumn("prefix", F.substring("target", F.lit(1), F.col("p")))
        req = tries.select("ctx", "prefix").distinct().withColumn("req_id", F.struct("ctx", "prefix")).withColumn("user", F.lit(None).cast("bigint"))
        r = self.rank(self.scored(req), k).select("ctx", "prefix", F.lower("shown").alias("target")).distinct()
        first = tries.join(r, ["ctx", "prefix", "target"]).groupBy("ctx", "target").agg(F.min("p").alias("p"))
        rows = n.join(first, ["ctx", "target"], "left")
        base, hit = F.length("target") + 1, F.col("p").isNotNull()
        sums = {"words": F.lit(1), "baseline": base, "cost": F.when(hit, F.col("p") + 1).otherwise(base), "accepted": hit.cast("int")}
        s = rows.agg(*[F.coalesce(F.sum(F.col("n") * x), F.lit(0)).alias(name) for name, x in sums.items()])
        return s.withColumn("savings", F.coalesce(1 - F.try_divide("cost", "baseline"), F.lit(0.0)))


def asked_positions(sents: DataFrame, cfg: EngineConfig = DEFAULT, prefix_len: int = 0) -> DataFrame:
    """(ctx, prefix, target) of held-out sentences: scorable targets, those longer than the prefix only."""
    from .lm import positions

    low = sents.withColumn("tokens", F.transform("tokens", lambda t: F.when(t == cfg.unk, t).otherwise(F.lower(t))))
    rows = positions(low, cfg.order, cfg).where(~F.col("word").isin(cfg.bos, cfg.eos, cfg.unk))
    if prefix_len:
        rows = rows.where(F.length("word") > prefix_len)
    return rows.select(
        "ctx", F.substring("word", 1, prefix_len).alias("prefix") if prefix_len else F.lit("").alias("prefix"), F.col("word").alias("target")
    )

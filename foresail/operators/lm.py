"""N-gram language models of any order as tables: counts, continuations, totals, pruning, four smoothing methods, perplexity, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.text import pad
from ..sources.bundle import materialize
from .corpus import Places, bounded_batches, few_words

BUCKET_TYPES = 32
#: contexts are broadcast up to this many, after a count
FEW_CONTEXTS = 100_000


def positions(sents: DataFrame, order: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(sid, pos, ctx, word): every predicted place with its order - 1 padded tokens before it."""
    p = sents.select("sid", pad(F.col("tokens"), order, cfg.bos, cfg.eos).alias("p"))
    p = p.select("sid", "p", F.explode(F.sequence(F.lit(order), F.size("p"))).alias("i"))
    return p.select(
        "sid", (F.col("i") - order).alias("pos"), F.slice("p", F.col("i") - (order - 1), order - 1).alias("ctx"),
        F.get("p", F.col("i") - 1).alias("word")
    )


def _keys(words: list[str], order: int, bits: int, bos: str, eos: str):
    """Arrow batches (sid, tokens) -> (sid, keys): at each place the numbers of the gram's words, bits each, in one bigint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, n = pa.array(words, pa.string()), order
        number = {w: i for i, w in enumerate(words) if w in (bos, eos)}
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            ids = pc.index_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + n)])  # each sentence with order - 1 marks before it and one behind
            padded = np.full(starts[-1], number.get(bos, 0), np.int64)
            padded[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * n + n - 1, sizes)] = ids
            padded[starts[1:] - 1] = number[eos]
            keys = padded.copy()
            for back in range(1, n):
                keys[n - 1 :] |= padded[n - 1 - back : len(padded) - back] << (bits * back)
            place = np.ones(len(padded), bool)
            for i in range(n - 1):
                place[starts[:-1] + i] = False
            offsets = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[place]))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["sid", "keys"])

    return run


def _named(words: list[str], bits: int):
    """Arrow batches (k, key, cnt, seen) -> (k, ctx, word, cnt, seen)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = pa.array(words, pa.string())
        for batch in batches:
            for k in pc.unique(batch.column(0)).to_pylist():
                b = batch.filter(pc.equal(batch.column(0), k))
                key = b.column(1).to_numpy()
                ids = [(key >> (bits * back)) & ((1 << bits) - 1) for back in range(k - 1, -1, -1)]
                before = np.stack(ids[:-1], axis=1).ravel() if k > 1 else np.zeros(0, np.int64)
                ctx = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * (k - 1)), names.take(pa.array(before)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), ctx, names.take(pa.array(ids[-1])), b.column(2), b.column(3)], names=["k", "ctx", "word", "cnt", "seen"]
                )

    return run


def _count_numbered(sents: DataFrame, order: int, cfg: EngineConfig, words: list[str], places: Places) -> DataFrame:
    """count_grams() over numbers of words: a gram is one bigint until all is counted."""
    bits = len(words).bit_length()
    rows = bounded_batches(sents.where("tokens IS NOT NULL").select(F.col("sid").cast("bigint").alias("sid"), "tokens"))
    rows = rows.mapInArrow(_keys(words, order, bits, cfg.bos, cfg.eos), "sid bigint, keys array<bigint>")
    rows = rows.select("sid", F.posexplode("keys").alias("pos", "key"))
    top = materialize(rows.groupBy("key").agg(F.count("*").alias("cnt"), places.first().alias("seen")))
    tables = [top.select(F.lit(order).alias("k"), "key", "cnt", "seen")]
    for k in range(order - 1, 0, -1):
        up = tables[-1].groupBy(F.col("key").bitwiseAND(F.lit((1 << (bits * k)) - 1)).alias("key"))
        up = up.agg(F.sum("cnt").alias("cnt"), F.min("seen").alias("seen"))
        tables.append(materialize(up).select(F.lit(k).alias("k"), "key", "cnt", "seen"))
    rows = bounded_batches(reduce(DataFrame.unionByName, tables))
    rows = rows.mapInArrow(_named(words, bits), "k int, ctx array<string>, word string, cnt bigint, seen bigint")
    return rows.select("k", "ctx", "word", "cnt", places.seen("seen").alias("first_seen"))


def count_grams(sents: DataFrame, order: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(k, ctx, word, cnt, first_seen) for k = 1..order. All orders count the same places, so lower orders roll up from the highest.

    Grams are counted as numbers if the vocabulary is small enough for a gram to fit a bigint, else as arrays of words.
    """
    words = few_words(model_vocab(sents, order, cfg))
    if words and order * len(words).bit_length() < 63 and (places := Places(sents)).bits is not None:
        return _count_numbered(sents, order, cfg, words, places)
    top = positions(sents, order, cfg).groupBy("ctx", "word").agg(F.count("*").alias("cnt"), F.min(F.struct("sid", "pos")).alias("first_seen"))
    tables = [top.select(F.lit(order).alias("k"), "ctx", "word", "cnt", "first_seen")]
    for k in range(order - 1, 0, -1):
        up = tables[-1].withColumn("ctx", F.slice("ctx", 2, k - 1) if k > 1 else F.array().cast("array<string>"))
        tables.append(
            up.groupBy("ctx", "word").agg(
                F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen")
            ).select(F.lit(k).alias("k"), "ctx", "word", "cnt", "first_seen")
        )
    return reduce(DataFrame.unionByName, tables)


def continuation_counts(grams: DataFrame) -> DataFrame:
    """(k, ctx, word, cnt): how many different words stand before each gram; from the grams one order up, so after pruning too."""
    g = grams.where("k > 1").select((F.col("k") - 1).alias("k"), F.slice("ctx", F.lit(2), F.greatest(F.col("k") - 2, F.lit(0))).alias("ctx"), "word")
    return g.groupBy("k", "ctx", "word").agg(F.count("*").alias("cnt"))


def context_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("k", "ctx").agg(F.sum("cnt").alias("total"), F.count("*").alias("n_types"))


def model_vocab(sents: DataFrame, order: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(word): all padded symbols; the start mark counts from order 2 on."""
    return sents.select(F.explode(pad(F.col("tokens"), order, cfg.bos, cfg.eos)).alias("word")).distinct()


def prune(grams: DataFrame, min_count: int, max_continuations: int) -> DataFrame:
    """Unigrams stay; other grams need min_count, and of each context the most frequent continuations stay."""
    w = Window.partitionBy("k", "ctx").orderBy(F.col("cnt").desc(), "first_seen")
    kept = grams.where((F.col("k") > 1) & (F.col("cnt") >= min_count))
    if max_continuations:
        kept = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_continuations).drop("r")
    return grams.where("k = 1").unionByName(kept)


def ranked(grams: DataFrame) -> DataFrame:
    """grams with r, each one's place in its context by count and first appearance: a cut by count keeps the first ones, so it serves many prunings."""
    w = Window.partitionBy("k", "ctx").orderBy(F.col("cnt").desc(), "first_seen")
    return grams.where("k = 1").withColumn("r", F.lit(0)).unionByName(grams.where("k > 1").withColumn("r", F.row_number().over(w)))


def prune_ranked(grams: DataFrame, min_count: int, max_continuations: int) -> DataFrame:
    """prune() of ranked grams."""
    kept = F.col("cnt") >= min_count
    if max_continuations:
        kept = kept & (F.col("r") <= max_continuations)
    return grams.where((F.col("k") == 1) | kept).drop("r")


def model_stats(grams: DataFrame, vocab: DataFrame) -> DataFrame:
    return grams.groupBy("k").agg(F.count("*").alias("grams"), F.sum("cnt").alias("tokens")).crossJoin(vocab.agg(F.count("*").alias("vocab_size")))


class NgramModel:
    """The tables of one model; everything but grams and vocabulary is derived."""

    def __init__(self, grams: DataFrame, vocab: DataFrame, order: int, cfg: EngineConfig = DEFAULT):
        if order < 1:
            raise ValueError("order must be 1 or more")
        self.grams, self.vocab, self.order, self.cfg = grams, vocab, order, cfg

    @classmethod
    def fit(cls, sents: DataFrame, order: int | None = None, cfg: EngineConfig = DEFAULT) -> NgramModel:
        order = order or cfg.order
        return cls(count_grams(sents, order, cfg), model_vocab(sents, order, cfg), order, cfg)

    def pruned(self, min_count: int | None = None, most: int | None = None) -> NgramModel:
        return NgramModel(
            prune(self.grams, min_count or self.cfg.prune_min_count, self.cfg.prune_max_continuations if most is None else most), self.vocab,
            self.order, self.cfg
        )

    def cached(self) -> NgramModel:
        return NgramModel(materialize(self.grams), materialize(self.vocab), self.order, self.cfg)

    def score(self, asked: DataFrame, methods=("mle", "laplace", "stupid_backoff", "kneser_ney")) -> DataFrame:
        """asked (ctx of order - 1 tokens, word, anything) with p_<method>; words outside the vocabulary are scored as the unknown word."""
        cfg, n, d = self.cfg, self.order, self.cfg.discount
        if tuple(methods) == ("stupid_backoff",):
            return self._backoff(asked)
        kn = "kneser_ney" in methods
        cont = continuation_counts(self.grams)
        known = self.vocab.select(F.col("word").alias("__w"), F.lit(True).alias("__in"))
        rows = asked.join(known, F.col("word") == F.col("__w"), "left").withColumn(
            "__word", F.when(F.col("__in"), F.col("word")).otherwise(cfg.unk)
        ).drop("__w", "__in")
        for k in range(n, 0, -1):
            rows = rows.withColumn(f"__c{k}", F.slice("ctx", F.lit(n - k + 1), F.lit(k - 1)) if k > 1 else F.array().cast("array<string>"))
        for k in range(n, 1, -1):
            g = self.grams.where(f"k = {k}")
            rows = rows.join(
                g.select(F.col("ctx").alias(f"__c{k}"), F.col("word").alias("__word"), F.col("cnt").alias(f"n{k}")), [f"__c{k}", "__word"], "left"
            )
            t = context_totals(g).select(F.col("ctx").alias(f"__c{k}"), F.col("total").alias(f"t{k}"), F.col("n_types").alias(f"y{k}"))
            rows = rows.join(t, f"__c{k}", "left")
        g1 = self.grams.where("k = 1")
        rows = rows.join(g1.select(F.col("word").alias("__word"), F.col("cnt").alias("n1")), "__word", "left")
        if kn:
            for k in range(n - 1, 0, -1):
                g = cont.where(f"k = {k}")
                rows = rows.join(
                    g.select(*([F.col("ctx").alias(f"__c{k}")] if k > 1 else []), F.col("word").alias("__word"), F.col("cnt").alias(f"m{k}")),
                    [f"__c{k}", "__word"] if k > 1 else ["__word"], "left"
                )
                if k > 1:
                    t = context_totals(g).select(F.col("ctx").alias(f"__c{k}"), F.col("total").alias(f"u{k}"), F.col("n_types").alias(f"z{k}"))
                    rows = rows.join(t, f"__c{k}", "left")
        # scalars of the model: one row
        one = g1.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("t1"), F.count("*").alias("y1")).crossJoin(self.vocab.agg(F.count("*").alias("v")))
        if n > 1 and kn:
            one = one.crossJoin(cont.where("k = 1").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("u1"), F.count("*").alias("z1")))
        rows = rows.crossJoin(F.broadcast(one))
        c = F.col
        zero = lambda x: F.coalesce(c(x), F.lit(0))
        out = {}
        out["mle"] = F.coalesce(F.try_divide(zero(f"n{n}"), c(f"t{n}")), F.lit(0.0))
        out["laplace"] = (zero(f"n{n}") + cfg.add_k) / (zero(f"t{n}") + cfg.add_k * c("v"))
        base = cfg.backoff_alpha ** (n - 1)
        sb = F.when(c("t1") == 0, F.lit(0.0)).when(zero("n1") > 0, base * c("n1") / c("t1")).otherwise(base * 1.0 / (c("t1") + c("v")))
        for k in range(2, n + 1):
            sb = F.when(zero(f"n{k}") > 0, cfg.backoff_alpha ** (n - k) * c(f"n{k}") / c(f"t{k}")).otherwise(sb)
        out["stupid_backoff"] = sb
        if kn:
            m, u, z = ("n1", "t1", "y1") if n == 1 else ("m1", "u1", "z1")
            p = F.when(c(u) == 0, 1.0 / c("v")).otherwise(F.greatest(zero(m) - d, F.lit(0.0)) / c(u) + (d * c(z) / c(u)) / c("v"))
            for k in range(2, n + 1):
                m, u, z = (f"n{k}", f"t{k}", f"y{k}") if k == n else (f"m{k}", f"u{k}", f"z{k}")
                p = F.when(zero(u) > 0, F.greatest(zero(m) - d, F.lit(0.0)) / c(u) + (d * c(z) / c(u)) * p).otherwise(p)
            out["kneser_ney"] = p
        return rows.select(*[c(x) for x in asked.columns], *[out[x].alias(f"p_{x}") for x in methods])

    def _backoff(self, asked: DataFrame) -> DataFrame:
        """score() by stupid backoff alone: a gram's share of its context is all that is looked up, with one join for each order."""
        cfg, n, c = self.cfg, self.order, F.col
        single = self.grams.where("k = 1").select("word", c("cnt").alias("n1"))
        # scalars of the model: one row
        one = single.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("t1"), F.max(F.when(c("word") == cfg.unk, c("n1"))).alias("nu"))
        one = one.crossJoin(self.vocab.agg(F.count("*").alias("v")))
        known = self.vocab.join(single, "word", "left").select(c("word").alias("__w"), F.lit(True).alias("__in"), "n1")
        rows = asked.join(known, c("word") == c("__w"), "left").crossJoin(F.broadcast(one))
        rows = rows.withColumn("__word", F.when(c("__in"), c("word")).otherwise(cfg.unk))
        rows = rows.withColumn("n1", F.coalesce(F.when(c("__in"), c("n1")).otherwise(c("nu")), F.lit(0)))
        base = cfg.backoff_alpha ** (n - 1)
        sb = F.when(c("t1") == 0, F.lit(0.0)).when(c("n1") > 0, base * c("n1") / c("t1")).otherwise(base * 1.0 / (c("t1") + c("v")))
        for k in range(2, n + 1):
            g = self.grams.where(f"k = {k}")
            g = g.join(g.groupBy("ctx").agg(F.sum("cnt").alias(f"t{k}")), "ctx")
            g = g.select(c("ctx").alias("__c"), c("word").alias("__word"), c("cnt").alias(f"n{k}"), f"t{k}")
            rows = rows.withColumn("__c", F.slice("ctx", F.lit(n - k + 1), F.lit(k - 1))).join(g, ["__c", "__word"], "left").drop("__c")
            sb = F.when(F.coalesce(c(f"n{k}"), F.lit(0)) > 0, cfg.backoff_alpha ** (n - k) * c(f"n{k}") / c(f"t{k}")).otherwise(sb)
        return rows.select(*[c(x) for x in asked.columns], sb.alias("p_stupid_backoff"))

    def perplexity(self, sents: DataFrame, methods=("mle", "laplace", "stupid_backoff", "kneser_ney")) -> DataFrame:
        """(method, perplexity): exp of the mean negative log over tokens and end marks; infinite if any probability is 0, or there is no token."""
        asked = positions(sents, self.order, self.cfg).groupBy("ctx", "word").agg(F.count("*").alias("w"))
        scored = self.score(asked, methods)
        parts = [F.struct(F.lit(m).alias("method"), F.col(f"p_{m}").alias("p")) for m in methods]
        long = scored.select("w", F.explode(F.array(*parts)).alias("x")).select("w", "x.*")
        agg = long.groupBy("method").agg(
            F.min("p").alias("least"), F.sum("w").alias("n"), F.sum(F.col("w") * F.when(F.col("p") > 0, F.ln("p"))).alias("ll")
        )
        return agg.select(
            "method",
            F.when((F.col("least") <= 0) | (F.col("n") == 0), F.lit(float("inf"))).otherwise(F.exp(-F.col("ll") / F.col("n"))).alias("perplexity")
        )

    def mass(self, contexts: DataFrame, methods=("mle", "laplace", "stupid_backoff", "kneser_ney")) -> DataFrame:
        """(ctx, mass_<method>): the sum over the vocabulary; the number of contexts is the caller's."""
        scored = self.score(contexts.select("ctx").crossJoin(self.vocab), methods)
        return scored.groupBy("ctx").agg(*[F.sum(f"p_{m}").alias(f"mass_{m}") for m in methods])

    def top_unigrams(self, most: int = 500) -> DataFrame:
        top = self.grams.where("k = 1").orderBy(F.col("cnt").desc(), "first_seen").limit(most)
        return top.where(~F.col("word").isin(self.cfg.bos, self.cfg.unk)).select("word", "cnt", "first_seen")

    def _candidate_words(self, contexts: DataFrame, k: int, quota: bool, exclude, unigrams: int | None) -> tuple[DataFrame, DataFrame]:
        """(id, word, prio, p) and (id, ctx): words seen after suffixes of a context, longest first, in order of first appearance, 5k at most.

        p is a word's share after the longest suffix that it follows, and prio how many tokens that suffix lacks. With a quota, a context's
        first 5k continuations and the first 5k unigrams are all that can be in it, so no more are joined.
        """
        blocked, most = [*exclude, self.cfg.bos, self.cfg.unk], 5 * k
        # contexts go by numbers: what is sorted and dealt out for each candidate has no arrays in it
        asked = materialize(contexts.select("ctx").distinct().withColumn("id", F.monotonically_increasing_id()))
        totals = self.grams.groupBy("k", "ctx").agg(F.sum("cnt").alias("t"))
        g = self.grams.join(totals, ["k", "ctx"]).where((F.col("k") > 1) & ~F.col("word").isin(*blocked))
        g = g.withColumn("r", F.row_number().over(Window.partitionBy("k", "ctx").orderBy("first_seen")))
        if quota:
            g = g.where(F.col("r") <= most)
        g = g.select("k", F.col("ctx").alias("c"), "word", F.col("r").cast("bigint").alias("r"), (F.col("cnt") / F.col("t")).alias("p"))
        place = lambda prio: (F.lit(prio << 40) + F.col("r")).alias("o")  # noqa: E731  shorter suffixes after all of the longer ones
        parts = []
        for o in range(self.order, 1, -1):
            own = asked.withColumn("c", F.slice("ctx", F.lit(self.order - o + 1), F.lit(o - 1)))
            parts.append(own.join(g.where(f"k = {o}"), "c").select("id", "word", place(self.order - o), "p"))
        single = self.grams.where("k = 1")
        t1 = single.agg(F.sum("cnt").alias("t"))
        uni = self.top_unigrams(unigrams) if unigrams else single
        uni = uni.where(~F.col("word").isin(*blocked)).crossJoin(F.broadcast(t1))  # one row
        if quota:
            uni = uni.orderBy(F.col("cnt").desc(), "first_seen").limit(most)
        uni = uni.withColumn("r", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "first_seen")))  # one row a word, most often 500 at most
        uni = uni.select("word", place(self.order - 1), (F.col("cnt") / F.col("t")).alias("p"))
        # at most 500 unigrams, or 5k; only without both bounds is it the whole vocabulary, which Spark then deals with as it can
        parts.append(asked.select("id").crossJoin(F.broadcast(uni) if unigrams or quota else uni))
        rows = reduce(DataFrame.unionByName, parts).groupBy("id", "word").agg(F.min("o").alias("o"), F.min_by("p", "o").alias("p"))
        if quota:
            rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("o"))).where(F.col("r") <= most)
        rows = rows.select("id", "word", F.shiftright("o", 40).cast("int").alias("prio"), "p")
        return rows, asked

    def candidate_words(self, contexts: DataFrame, k: int, quota: bool = True, exclude=(), unigrams: int | None = 500) -> DataFrame:
        """(ctx, word, prio, p) of the candidates."""
        words, asked = self._candidate_words(contexts, k, quota, exclude, unigrams)
        return words.join(asked, "id").select("ctx", "word", "prio", "p")

    def candidates(self, contexts: DataFrame, k: int, method: str | None = None) -> DataFrame:
        """(ctx, rank, word, score): the k best next words of each context. Stupid backoff's score is known where a word was found."""
        method = method or self.cfg.smoothing
        if method == "stupid_backoff":
            words, asked = self._candidate_words(contexts, k, True, (), 500)
            alpha = F.element_at(F.array(*[F.lit(float(self.cfg.backoff_alpha**i)) for i in range(self.order)]), F.col("prio") + 1)
            best = top_k(words.select("id", "word", (alpha * F.col("p")).alias("score")), ["id"], k)
            return best.join(asked, "id").select("ctx", "word", "score", "rank")
        scored = self.score(self.candidate_words(contexts, k).select("ctx", "word"), (method,)).withColumnRenamed(f"p_{method}", "score")
        return top_k(scored, ["ctx"], k)

    def sampling_table(self, grams: DataFrame | None = None) -> DataFrame:
        """Of the model's grams, or of some contexts' whole grams: (k, c, word, lo, hi, b, total, nb): each word's stretch [lo, hi) of its context's counts, once for each of the context's nb
        buckets of equal mass that the stretch meets. Words stand by the first byte of their digest, then by themselves, so that
        the running sums of a large context are those of 256 parts and their offsets."""
        g = self.grams if grams is None else grams
        g = g.where(F.col("word") != self.cfg.bos).withColumn("h", F.substring(F.md5("word"), 1, 2))
        parts = g.groupBy("k", "ctx", "h").agg(F.sum("cnt").alias("m"), F.count("*").alias("types"))
        own = Window.partitionBy("k", "ctx")
        before = F.coalesce(F.sum("m").over(own.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nb = F.ceil(F.sum("types").over(own) / BUCKET_TYPES)
        parts = parts.select("k", "ctx", "h", before.alias("before"), F.sum("m").over(own).alias("total"), nb.alias("nb"))
        run = F.sum("cnt").over(Window.partitionBy("k", "ctx", "h").orderBy("word").rowsBetween(Window.unboundedPreceding, 0))
        rows = g.withColumn("run", run).join(parts, ["k", "ctx", "h"]).withColumn(
            "hi", F.col("before") + F.col("run")
        ).withColumn("lo", F.col("hi") - F.col("cnt"))
        at = lambda x: F.floor(x * F.col("nb") / F.col("total"))
        return rows.select(
            "k", F.col("ctx").alias("c"), "word", "lo", "hi", "total", "nb", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi") - 1))).alias("b")
        )

    def generate(self, start: DataFrame, length: int, seed: int = 0) -> DataFrame:
        """(ctx, generated): words drawn by digests of context and step from the longest context seen, until an end mark or the length.

        A draw is a place among a context's counts; contexts meet one bucket of their stretches, never their whole continuations.
        Stretches are made for the contexts that a step has come to, not for all.
        """
        n, cfg = self.order, self.cfg
        rows = start.select("ctx").distinct().select("ctx", F.col("ctx").alias("now"), F.array().cast("array<string>").alias("generated"))
        rows, single = materialize(rows), materialize(self.sampling_table(self.grams.where("k = 1")))
        for step in range(length):
            asked = []
            for k in range(n, 1, -1):
                need = materialize(rows.select(F.slice("now", F.lit(n - k + 1), F.lit(k - 1)).alias("ctx")).distinct())
                asked.append(self.grams.where(f"k = {k}").join(F.broadcast(need) if need.count() <= FEW_CONTEXTS else need, "ctx", "left_semi"))
            cum = single
            if asked:
                own = materialize(reduce(DataFrame.unionByName, asked).select("k", "ctx", "word", "cnt"))  # read twice
                cum = materialize(self.sampling_table(own)).unionByName(single)
            sizes = cum.select("k", "c", "total", "nb").distinct()
            key = F.concat(F.lit(f"{seed}:{step}:"), F.array_join("ctx", " "))
            u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)
            done = F.coalesce(F.element_at("generated", -1) == cfg.eos, F.lit(False)) if step else F.lit(False)
            rows = rows.withColumn("u", u).withColumn("done", done).withColumn("new", F.when(F.col("done"), F.lit(cfg.eos)))
            for k in range(n, 0, -1):
                c = F.slice("now", F.lit(n - k + 1), F.lit(k - 1)) if k > 1 else F.array().cast("array<string>")
                rows = rows.withColumn("c", F.when(F.col("new").isNull(), c))  # null where a longer context gave a word
                rows = rows.join(sizes.where(f"k = {k}").drop("k"), "c", "left").withColumn("at", F.floor(F.col("u") * F.col("total")))
                rows = rows.withColumn("b", F.floor(F.col("at") * F.col("nb") / F.col("total"))).drop("total", "nb")
                t = cum.where(f"k = {k}").select(F.col("c").alias("c2"), F.col("b").alias("b2"), F.col("word").alias("drawn"), "lo", "hi")
                hit = (F.col("c") == F.col("c2")) & (F.col("b") == F.col("b2")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
                rows = rows.join(t, hit, "left").withColumn("new", F.coalesce("new", "drawn")).drop("c", "c2", "b", "b2", "at", "drawn", "lo", "hi")
            now = F.when(F.col("done"), F.col("now")).otherwise(F.slice(F.concat("now", F.array("new")), 2, n - 1)) if n > 1 else F.col("now")
            grown = F.when(F.col("done"), F.col("generated")).otherwise(F.concat("generated", F.array("new")))
            rows = materialize(rows.select("ctx", now.alias("now"), grown.alias("generated")))
        return rows.select("ctx", "generated")


def rank_key(score: Column) -> Column:
    """Scores of two engines differ in the last digit: ranks go by the rounded logarithm."""
    return F.when(score > 0, F.round(F.ln(score), 9)).otherwise(F.lit(-1e300))


def top_k(scored: DataFrame, by: list[str], k: int, key: Column | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy((rank_key(F.col("score")) if key is None else key).desc(), "word")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

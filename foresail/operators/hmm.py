"""A bigram hidden-Markov tagger as tables: counts, smoothed parameters, unseen words, Viterbi as a fold, evaluation."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..sources.bundle import materialize
from .corpus import Places

CONFIDENCE = 0.9
NEVER = -1e30
BLOCK = 64


def _prev(c: str) -> Column:
    return F.lag(c).over(Window.partitionBy("sid").orderBy("pos"))


class HMMTagger:
    """Parameters from a tagged corpus (sid, pos, word, tag). The tag set is small and lives on the driver; words stay in tables."""

    def __init__(self, tagged: DataFrame, cfg: EngineConfig = DEFAULT):
        self.tagged, self.cfg = tagged, cfg
        last = Window.partitionBy("sid")
        rows = tagged.withColumn("prev", _prev("tag")).withColumn("end", F.col("pos") == F.max("pos").over(last))
        self.tag_counts = rows.groupBy("tag").agg(
            F.count("*").alias("cnt"), F.count_if(F.col("prev").isNull()).alias("starts"), F.count_if("end").alias("finals")
        )
        self.transitions = rows.where("prev IS NOT NULL").groupBy("prev", "tag").agg(F.count("*").alias("cnt"))
        self.emissions = tagged.groupBy("word", "tag").agg(F.count("*").alias("cnt"), F.min(F.struct("sid", "pos")).alias("seen"))

    @classmethod
    def of_words(cls, sents: DataFrame, tag: Callable[[Column], Column], cfg: EngineConfig = DEFAULT) -> HMMTagger:
        """A tagger of sentences (sid, tokens) whose tags follow from the words alone, so that words are counted before they are tagged."""
        tags = sents.where(F.size("tokens") > 0).select(F.transform("tokens", tag).alias("t"))
        before = F.concat(F.array(F.lit(None).cast("string")), "t")  # one more than tags; the last one's neighbour is the end
        after = F.concat("t", F.array(F.lit(None).cast("string")))
        pairs = tags.select(F.explode(F.arrays_zip(before.alias("prev"), after.alias("tag"))).alias("x")).groupBy("x.prev", "x.tag")
        pairs = materialize(pairs.agg(F.count("*").alias("cnt")))
        count = lambda hit: F.sum(F.when(hit, F.col("cnt")).otherwise(0)).alias
        own = pairs.select(F.explode(F.array(
            F.struct(F.col("tag").alias("tag"), F.lit(True).alias("own"), F.col("prev").isNull().alias("edge"), "cnt"),
            F.struct(F.col("prev").alias("tag"), F.lit(False).alias("own"), F.col("tag").isNull().alias("edge"), "cnt"),
        )).alias("x")).select("x.*").where("tag IS NOT NULL")
        counts = own.groupBy("tag").agg(
            count(F.col("own"))("cnt"), count(F.col("own") & F.col("edge"))("starts"), count(~F.col("own") & F.col("edge"))("finals")
        )
        places = Places(sents)
        words = sents.select("sid", F.posexplode("tokens").alias("pos", "word")).groupBy("word")
        words = words.agg(F.count("*").alias("cnt"), places.first().alias("seen"))
        emissions = words.select("word", tag(F.col("word")).alias("tag"), "cnt", places.seen("seen").alias("seen"))
        return cls.from_counts(counts, pairs.where("prev IS NOT NULL AND tag IS NOT NULL"), materialize(emissions), cfg)

    @classmethod
    def from_counts(cls, tag_counts: DataFrame, transitions: DataFrame, emissions: DataFrame, cfg: EngineConfig = DEFAULT) -> HMMTagger:
        """A tagger from saved counts; load() derives the rest."""
        t = cls.__new__(cls)
        t.tagged, t.cfg, t.tag_counts, t.transitions, t.emissions = None, cfg, tag_counts, transitions, emissions
        return t

    def load(self) -> HMMTagger:
        """Reads the tag tables, which have one row a tag and pair of tags, to the driver."""
        if not (rows := sorted(self.tag_counts.collect(), key=lambda r: r.tag)):
            raise ValueError("a tagger needs a tagged corpus; this one has no tokens")
        self.tags = [r.tag for r in rows]
        self.totals = [r["cnt"] for r in rows]
        self.starts, self.finals = [r.starts for r in rows], [r.finals for r in rows]
        self.trans = {(r.prev, r.tag): r["cnt"] for r in self.transitions.collect()}
        by_word = self.emissions.groupBy("word").agg(F.sum("cnt").alias("n"), F.min("tag").alias("tag"))
        once = by_word.groupBy(F.when(F.col("n") == 1, F.col("tag")).alias("tag")).agg(F.count("*").alias("h")).collect()
        self.n_words = sum(r.h for r in once)
        self.hapax = {r.tag: r.h for r in once if r.tag is not None}
        seen = {r.tag: tuple(r.s) for r in self.emissions.groupBy("tag").agg(F.min("seen").alias("s")).collect()}
        self.most_frequent = min(self.tags, key=lambda t: (-self.totals[self.tags.index(t)], seen[t]))
        return self._derive()

    def _derive(self) -> HMMTagger:
        """Smoothed parameters from the counts."""
        k, n = self.cfg.hmm_k, len(self.tags)
        den = [t + k * (n + 1) for t in self.totals]
        sents, total, once = sum(self.starts), sum(self.totals), sum(self.hapax.values())
        self.log_initial = [math.log(x + k) - math.log(sents + k * n) for x in self.starts]
        self.log_transition = [[math.log(self.trans.get((a, b), 0) + k) - math.log(den[i]) for b in self.tags] for i, a in enumerate(self.tags)]
        self.log_final = [math.log(x + k) - math.log(den[i]) for i, x in enumerate(self.finals)]
        self.emit_den = [t + k * (self.n_words + 1) for t in self.totals]
        self.unk_laplace = [math.log(k) - math.log(d) for d in self.emit_den]
        self.log_prior = [math.log(t / total) for t in self.totals]
        hapax = [math.log((self.hapax.get(t, 0) + k) / (once + k * n)) - self.log_prior[i] for i, t in enumerate(self.tags)] if once else None
        self.unk_hapax = hapax or self.unk_laplace
        return self

    def smoothed(self, k: float) -> HMMTagger:
        """The same counts under another smoothing constant; nothing is counted again."""
        other = copy.copy(self)
        other.cfg = self.cfg.override(hmm_k=k)
        return other._derive()

    def emission_table(self) -> DataFrame:
        """(word, emit array<double>) in the order of tags."""
        k = self.cfg.hmm_k
        counts = self.emissions.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("tag", "cnt"))).alias("m"))
        cols = [F.ln(F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0)) + k) - math.log(self.emit_den[i]) for i, t in enumerate(self.tags)]
        return counts.select("word", F.array(*cols).alias("emit"))

    def unknown_emission(self, word: Column, is_first: Column, strategy: str | None = None, prior: str | None = None) -> Column:
        """The emission of an unseen word: the prior, with most of the mass moved to the tags its shape names."""
        strategy, prior = strategy or self.cfg.unknown_strategy, prior or self.cfg.unknown_prior
        base = self.unk_hapax if prior == "hapax" else self.unk_laplace

        def lit(xs):
            return F.array(*[F.lit(float(x)) for x in xs])

        def boosted(wanted):
            hit = [i for i, t in enumerate(self.tags) if t in wanted]
            if not hit:
                return lit(base)
            out = [b + math.log(1.0 - CONFIDENCE) for b in base]
            for i in hit:
                a, b = out[i], base[i] + math.log(CONFIDENCE / len(hit))
                out[i] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
            return lit(out)

        if strategy == "uniform":
            return lit(base)
        if strategy == "most_frequent_tag":
            return boosted([self.most_frequent])
        names = T.candidate_tags(word, is_first)
        kinds = {tuple(t) for _, t in (*T.SUFFIX_RULES, *T.DEVANAGARI_RULES)} | {T.PUNCT_TAGS, T.NUM_TAGS, T.PROPER_TAGS}
        out = None
        for kind in sorted(kinds):
            hit = names == F.array(*map(F.lit, kind))
            out = F.when(hit, boosted(kind)) if out is None else out.when(hit, boosted(kind))
        return out.otherwise(lit(base))

    def with_emissions(self, rows: DataFrame, strategy: str | None = None, prior: str | None = None) -> DataFrame:
        """rows (sid, pos, word) with emit and known: the exact form, the lower-case form, else the unseen-word model."""
        table = self.emission_table()
        kinds = rows.select("word", (F.col("pos") == 0).alias("f")).distinct().withColumn("low", F.lower("word"))
        kinds = kinds.join(table.withColumnRenamed("emit", "e1"), "word", "left").join(
            table.select(F.col("word").alias("low"), F.col("emit").alias("e2")), "low", "left"
        )
        seen = F.coalesce("e1", "e2")
        kinds = kinds.select(
            "word", "f", F.coalesce(seen, self.unknown_emission(F.col("word"), F.col("f"), strategy, prior)).alias("emit"),
            seen.isNotNull().alias("known")
        )
        return rows.withColumn("f", F.col("pos") == 0).join(kinds, ["word", "f"]).drop("f")

    def _fold(self, emits: Column, keep: str = "", linear: bool = False) -> Column:
        """struct<s array<double>, x array<array<...>>>: Viterbi over an array of emissions. keep: '' last scores only, 'back' pointers,
        'trellis' the scores of every place. What is kept grows in blocks, so that a long sentence isn't copied at each of its places."""
        n = len(self.tags)
        f = (lambda x: math.exp(x)) if linear else (lambda x: x)
        op = (lambda a, b: a * b) if linear else (lambda a, b: a + b)
        emit = (lambda e: F.transform(e, lambda x: F.exp(x))) if linear else (lambda e: e)
        into = [F.array(*[F.lit(f(self.log_transition[i][j])) for i in range(n)]) for j in range(n)]
        first = F.zip_with(F.array(*[F.lit(f(x)) for x in self.log_initial]), emit(F.get(emits, 0)), op)
        none = F.array().cast({"trellis": "array<array<double>>"}.get(keep, "array<array<int>>"))

        def step(acc, e):
            ways = F.array(*[F.zip_with(acc["s"], into[j], op) for j in range(n)])
            s = F.zip_with(F.transform(ways, lambda w: F.array_max(w)), emit(e), op)
            if not keep:
                return F.struct(s.alias("s"), acc["x"].alias("x"))
            new = s if keep == "trellis" else F.transform(ways, lambda w: (F.array_position(w, F.array_max(w)) - 1).cast("int"))
            return F.struct(s.alias("s"), F.concat(acc["x"], F.array(new)).alias("x"))

        if not keep:
            return F.aggregate(F.slice(emits, F.lit(2), F.greatest(F.size(emits) - 1, F.lit(0))), F.struct(first.alias("s"), none.alias("x")), step)

        def block(acc, at):
            part = F.slice(emits, at, F.lit(BLOCK))
            inner = F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("x")), step)
            return F.struct(inner["s"].alias("s"), F.concat(acc["x"], F.array(inner["x"])).alias("x"))

        starts = F.when(
            F.size(emits) > 1, F.sequence(F.lit(2), F.greatest(F.size(emits), F.lit(2)), F.lit(BLOCK))
        ).otherwise(F.array().cast("array<int>"))
        head = F.array(F.array(first)) if keep == "trellis" else F.array().cast("array<array<array<int>>>")
        return F.aggregate(starts, F.struct(first.alias("s"), head.alias("x")), block)

    def _emit_arrays(self, rows: DataFrame, strategy: str | None = None, prior: str | None = None) -> DataFrame:
        """(sid, emits), the emissions of each sentence in order."""
        emitted = self.with_emissions(rows, strategy, prior)
        s = emitted.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "emit"))).alias("x"))
        return s.select("sid", F.transform("x", lambda v: v["emit"]).alias("emits"))

    def _best(self, scores: str) -> Column:
        return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

    def names(self) -> Column:
        return F.array(*map(F.lit, self.tags))

    def decode(self, rows: DataFrame, strategy: str | None = None, prior: str | None = None) -> DataFrame:
        """(sid, path array<string>, score): best tags of whole sentences and their log score."""
        s = self._emit_arrays(rows, strategy, prior).select("sid", self._fold(F.col("emits"), "back").alias("v"))
        final = F.zip_with(F.col("v.s"), F.array(*[F.lit(x) for x in self.log_final]), lambda a, b: a + b)
        s = s.select("sid", F.col("v.x").alias("back"), final.alias("final")).withColumn("last", self._best("final"))

        def back(acc, blocks):
            own = F.struct(acc["i"].alias("i"), F.array().cast("array<int>").alias("p"))
            inner = F.aggregate(
                F.reverse(blocks), own, lambda a, b: F.struct(F.get(b, a["i"]).alias("i"), F.concat(a["p"], F.array(F.get(b, a["i"]))).alias("p"))
            )
            return F.struct(inner["i"].alias("i"), F.concat(acc["p"], F.array(inner["p"])).alias("p"))

        start = F.struct(F.col("last").alias("i"), F.array(F.array("last")).alias("p"))
        ids = F.reverse(F.flatten(F.aggregate(F.reverse("back"), start, back)["p"]))
        names = self.names()
        return s.select("sid", F.transform(ids, lambda i: F.get(names, i)).alias("path"), F.array_max("final").alias("score"))

    def trellis(self, rows: DataFrame) -> DataFrame:
        """(sid, trellis array<array<double>>): the scores of every tag at every place, without the end."""
        s = self._emit_arrays(rows).select("sid", self._fold(F.col("emits"), "trellis").alias("v"))
        return s.select("sid", F.flatten("v.x").alias("trellis"))

    def last_tags(self, rows: DataFrame) -> DataFrame:
        """(sid, tag): the best tag at the last place, the end not counted."""
        s = self._emit_arrays(rows).select("sid", self._fold(F.col("emits"))["s"].alias("column"))
        return s.select("sid", F.get(self.names(), self._best("column")).alias("tag"))

    def underflow(self, rows: DataFrame) -> DataFrame:
        """(sid, n, underflowed): whether the recursion in plain probabilities ends in zeros only."""
        s = self._emit_arrays(rows)
        s = s.select("sid", F.size("emits").alias("n"), self._fold(F.col("emits"), linear=True)["s"].alias("s"))
        final = F.zip_with("s", F.array(*[F.lit(math.exp(x)) for x in self.log_final]), lambda a, b: a * b)
        return s.select("sid", "n", (F.array_max(final) <= 0).alias("underflowed"))

    def inspect(self) -> dict:
        """Sizes and settings of the fitted tagger."""
        return {"tags": len(self.tags), "words": self.n_words, "sentences": sum(self.starts), "tokens": sum(self.totals), "k": self.cfg.hmm_k,
                "unknown_strategy": self.cfg.unknown_strategy, "unknown_prior": self.cfg.unknown_prior}

    def predictions(self, gold: DataFrame, **kw) -> DataFrame:
        """(sid, pos, word, gold, pred, known)."""
        path = self.decode(gold.select("sid", "pos", "word"), **kw).select("sid", F.posexplode("path").alias("i", "pred"))
        order = gold.withColumn("i", F.row_number().over(Window.partitionBy("sid").orderBy("pos")) - 1)
        known = self.known(gold.select("word").distinct())
        return order.join(path, ["sid", "i"]).join(known, "word").select("sid", "pos", "word", F.col("tag").alias("gold"), "pred", "known")

    def known(self, words: DataFrame) -> DataFrame:
        seen = self.emissions.select("word").distinct()
        a = words.withColumn("low", F.lower("word")).join(seen.withColumn("k1", F.lit(True)), "word", "left").join(
            seen.select(F.col("word").alias("low"), F.lit(True).alias("k2")), "low", "left"
        )
        return a.select("word", F.coalesce("k1", "k2", F.lit(False)).alias("known"))

    def sequence_logprob(self, gold: DataFrame) -> DataFrame:
        """(sid, logprob) of tagged sentences, ends included; a tag that was never seen makes it -1e30."""
        ix = F.create_map(*[x for i, t in enumerate(self.tags) for x in (F.lit(t), F.lit(i))])
        rows = self.with_emissions(gold.select("sid", "pos", "word", "tag")).withColumn("t", F.try_element_at(ix, F.col("tag")))
        w = Window.partitionBy("sid").orderBy("pos")
        rows = rows.withColumn("p", F.lag("t").over(w)).withColumn("end", F.lead("pos").over(w).isNull()).withColumn(
            "first", F.lag("pos").over(w).isNull()
        )
        lit = lambda xs: F.array(*map(F.lit, xs))
        flat = lit([x for row in self.log_transition for x in row])
        into = F.when(F.col("first"), F.get(lit(self.log_initial), F.col("t"))).otherwise(F.get(flat, F.col("p") * len(self.tags) + F.col("t")))
        out = F.when(F.col("end"), F.get(lit(self.log_final), F.col("t"))).otherwise(0.0)
        rows = rows.withColumn("lp", into + F.get("emit", F.col("t")) + out)
        return rows.groupBy("sid").agg(F.when(F.count_if(F.col("t").isNull()) > 0, NEVER).otherwise(F.sum("lp")).alias("logprob"))


def evaluate(preds: DataFrame) -> DataFrame:
    ok = F.col("gold") == F.col("pred")
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return preds.agg(
        F.count("*").alias("tokens"), div(F.count_if(ok), F.count("*")).alias("accuracy"), div(
            F.count_if(ok & F.col("known")), F.count_if("known")
        ).alias("known_accuracy"),
        div(
            F.count_if(ok & ~F.col("known")), F.count_if(~F.col("known"))
        ).alias("unknown_accuracy"), div(F.count_if(~F.col("known")), F.count("*")).alias("oov_rate"),
    )


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("gold", "pred").agg(F.count("*").alias("cnt"))


def baseline(tagged: DataFrame) -> DataFrame:
    """(lower, tag): the most frequent tag of each lower-cased word, ties by first appearance."""
    c = tagged.groupBy(F.lower("word").alias("lower"), "tag").agg(F.count("*").alias("cnt"), F.min(F.struct("sid", "pos")).alias("s"))
    return c.groupBy("lower").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "s", "tag")).alias("b")).select("lower", F.col("b.tag").alias("tag"))


def modal_tag(tagged: DataFrame) -> DataFrame:
    c = tagged.groupBy("tag").agg(F.count("*").alias("cnt"), F.min(F.struct("sid", "pos")).alias("s"))
    return c.agg(F.min(F.struct((-F.col("cnt")).alias("n"), "s", "tag")).alias("b")).select(F.col("b.tag").alias("tag"))


def punctuation_tag(tagged: DataFrame) -> DataFrame:
    rows = tagged.where((F.trim("tag") != "") & (F.trim("word") != "") & ~F.col("word").rlike(r"[\p{L}\p{N}]"))
    return modal_tag(rows).select(F.coalesce("tag", F.lit(T.PUNCT_TAGS[0])).alias("tag"))


def clean_tagged(tagged: DataFrame, nfc: bool = True) -> DataFrame:
    """Words in NFC and trimmed, blank words and tags dropped, trailing dandas as tokens of their own with the corpus's punctuation tag."""
    mark = punctuation_tag(tagged).withColumnRenamed("tag", "mark")
    rows = T.normalize_nfc(tagged, "word") if nfc else tagged
    rows = rows.withColumn("word", F.trim("word")).withColumn("tag", F.trim("tag")).where("word <> '' AND tag <> ''")
    rows = rows.crossJoin(F.broadcast(mark))  # one row
    stem = F.rtrim("word", F.lit("।॥"))
    tail = F.substring(F.col("word"), F.length(stem) + 1, F.length("word"))
    parts = F.concat(
        F.when(
            stem != "", F.array(F.struct(stem.alias("word"), F.col("tag").alias("tag")))
        ).otherwise(F.array().cast("array<struct<word:string,tag:string>>")),
        F.transform(F.filter(F.split(tail, ""), lambda c: c != ""), lambda c: F.struct(c.alias("word"), F.col("mark").alias("tag"))),
    )
    rows = rows.select("sid", "pos", F.posexplode(parts).alias("j", "x"))
    return rows.select("sid", (F.row_number().over(Window.partitionBy("sid").orderBy("pos", "j")) - 1).alias("pos"), "x.word", "x.tag")


def tagged_stats(tagged: DataFrame) -> DataFrame:
    s = tagged.agg(
        F.count_distinct("sid").alias("sentences"), F.count("*").alias("tokens"), F.count_distinct("word").alias("types"),
        F.count_distinct("tag").alias("tags")
    )
    s = s.crossJoin(modal_tag(tagged).withColumnRenamed("tag", "most_common_tag"))
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return s.select(
        "sentences", "tokens", "types", div("types", "tokens").alias("ttr"), div("tokens", "sentences").alias("mean_len"), "tags", "most_common_tag"
    )


def suffix_report(tagged: DataFrame) -> DataFrame:
    """(suffix, types, correct, purity) over word types; the words aren't lower-cased."""
    c = tagged.groupBy("word", "tag").agg(F.count("*").alias("cnt"), F.min(F.struct("sid", "pos")).alias("s"))
    types = c.groupBy("word").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "s", "tag")).alias("b")).select("word", F.col("b.tag").alias("gold"))
    rules = {s: t for s, t in (*T.SUFFIX_RULES, *T.DEVANAGARI_RULES)}
    suffix = F.when(T.contains_devanagari(F.col("word")), T.match_suffix(F.col("word"), T.DEVANAGARI_RULES)).otherwise(T.match_suffix(F.col("word")))
    names = F.create_map(*[x for s, t in rules.items() for x in (F.lit(s), F.array(*map(F.lit, t)))])
    rows = types.withColumn("suffix", suffix).where("suffix IS NOT NULL").withColumn(
        "ok", F.array_contains(F.element_at(names, F.col("suffix")), F.col("gold"))
    )
    return rows.groupBy("suffix").agg(
        F.count("*").alias("types"), F.count_if("ok").alias("correct")
    ).withColumn("purity", F.col("correct") / F.col("types"))

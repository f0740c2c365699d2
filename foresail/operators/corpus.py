"""Corpora as tables: sentences, tokens, vocabularies, truecase maps, splits and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..sources.bundle import materialize


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nfc: bool = True) -> DataFrame:
    """(sid, doc_id, si, sentence, tokens) in corpus order sid = doc_id * 10^6 + si; sentences without tokens are dropped."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c for c in ("lang",) if c in docs.columns])
    rows = T.normalize_nfc(rows, "text") if nfc else rows
    rows = rows.select("*", F.posexplode(T.split_sentences(T.clean_text(F.col("text")))).alias("si", "sentence")).drop("text")
    # not by size(tokens): such a filter moves below the tokens, which are then computed twice
    rows = rows.where(T.has_token(F.col("sentence"))).withColumn("tokens", T.tokenize(F.col("sentence")))
    return rows.withColumn("sid", F.col("doc_id") * 1_000_000 + F.col("si"))


def tokens(sents: DataFrame) -> DataFrame:
    return sents.select("sid", F.posexplode("tokens").alias("pos", "tok"))


class Places:
    """Places (sid, pos) of a sentence table as one bigint each, so that first places are kept by hashing; as structs, and by sorting, if they don't fit."""

    def __init__(self, sents: DataFrame):
        self.bits = None
        if dict(sents.dtypes)["sid"] in ("tinyint", "smallint", "int", "bigint"):
            r = sents.agg(F.min("sid"), F.max("sid"), F.max(F.size("tokens")), F.count_if(F.col("sid").isNull())).first()
            bits = max(r[2] or 0, 1).bit_length()
            if not r[3] and (r[0] is None or -(1 << (62 - bits)) <= r[0] and r[1] < 1 << (62 - bits)):
                self.bits = bits

    def place(self) -> Column:
        if self.bits is None:
            return F.struct("sid", "pos")
        return F.shiftleft(F.col("sid").cast("bigint"), self.bits).bitwiseOR(F.col("pos").cast("bigint"))

    def first(self) -> Column:
        return F.min(self.place())

    def seen(self, c: str) -> Column:
        """struct<sid, pos> of a place."""
        if self.bits is None:
            return F.col(c)
        return F.struct(F.shiftright(c, self.bits).alias("sid"), F.col(c).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int").alias("pos"))


def first_seen() -> Column:
    return F.min(F.struct("sid", "pos"))


def build_vocab(
    sents: DataFrame, cfg: EngineConfig = DEFAULT, max_size: int | None = None, lowercase: bool = True, places: Places | None = None
) -> DataFrame:
    """(word, cnt, first_seen, in_vocab): all types are counted; kept are those of min_freq or more, at most max_size by count and first place."""
    word = F.lower("tok") if lowercase else F.col("tok")
    places = places or Places(sents)
    v = tokens(sents).groupBy(word.alias("word")).agg(F.count("*").alias("cnt"), places.first().alias("first_seen"))
    v = v.withColumn("first_seen", places.seen("first_seen")).withColumn("in_vocab", F.col("cnt") >= cfg.min_freq)
    size = cfg.max_vocab if max_size is None else max_size
    if not size:
        return v
    v = materialize(v)  # read twice
    top = v.where("in_vocab").orderBy(F.col("cnt").desc(), "first_seen").limit(size).select("word", F.lit(True).alias("top"))
    return v.join(top, "word", "left").withColumn("in_vocab", F.coalesce("top", F.lit(False))).drop("top")


def _regrouped(sents: DataFrame, rows: DataFrame, word: Column) -> DataFrame:
    """Sentences again from their rows (sid, pos, __o, ...); __o holds the other columns, so that nothing is joined back."""
    t = rows.groupBy("sid").agg(F.first("__o").alias("__o"), F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))).alias("x"))
    others = [F.col(f"__o.{c}").alias(c) for c in sents.columns if c not in ("sid", "tokens")]
    return t.select("sid", *others, F.transform("x", lambda x: x["w"]).alias("tokens"))


def _exploded(sents: DataFrame) -> DataFrame:
    others = [F.col(c) for c in sents.columns if c not in ("sid", "tokens")] or [F.lit(0).alias("none")]
    return sents.select("sid", F.struct(*others).alias("__o"), F.posexplode("tokens").alias("pos", "tok")).withColumn("word", F.lower("tok"))


#: up to so many words are held by every task, to look tokens up in place
MOST_WORDS = 100_000


def few_words(words: DataFrame) -> list[str] | None:
    """The words in order if they are no more than MOST_WORDS and none is null, else None."""
    rows = [r[0] for r in words.limit(MOST_WORDS + 1).collect()]
    return sorted(rows) if len(rows) <= MOST_WORDS and None not in rows else None


BATCH_ROWS = 1000


def bounded_batches(rows: DataFrame) -> DataFrame:
    """The rows; Arrow batches of their session get at most BATCH_ROWS, as a sentence can be long."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", rows.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return rows


def _looked_up(words: list[str], unk: str):
    """Arrow batches with those tokens replaced that are none of the words."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(words, pa.string())
        for b in batches:
            at = b.schema.get_field_index("tokens")
            lists = b.column(at)
            flat = lists.flatten()
            flat = pc.if_else(pc.is_in(flat, value_set=known), flat, pa.scalar(unk, pa.string()))
            lists = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), flat)
            yield pa.RecordBatch.from_arrays([lists if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return run


def apply_unk(sents: DataFrame, vocab: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The sentences with tokens lower-cased, and those outside the vocabulary replaced. Sids are unique.

    Tasks look tokens up in place if the kept words are few; else tokens meet the vocabulary by a join and are put together again.
    """
    words = few_words(vocab.where("in_vocab").select("word"))
    if words is not None:
        low = sents.where(F.size("tokens") > 0).withColumn("tokens", F.transform("tokens", lambda t: F.lower(t)))
        return bounded_batches(low).mapInArrow(_looked_up(words, cfg.unk), low.schema)
    kept = vocab.where("in_vocab").select("word", F.lit(True).alias("known"))
    rows = _exploded(sents).join(kept, "word", "left")
    return _regrouped(sents, rows, F.when(F.col("known"), F.col("word")).otherwise(F.lit(cfg.unk)))


def truecase_map(sents: DataFrame, places: Places | None = None) -> DataFrame:
    """(lower, surface): the most frequent form beyond first places; a cased form must beat the lower-case one."""
    places = places or Places(sents)
    forms = tokens(sents).where("pos > 0").groupBy(
        F.lower("tok").alias("lower"), F.col("tok").alias("surface")
    ).agg(F.count("*").alias("cnt"), places.first().alias("seen"))
    best = forms.groupBy("lower").agg(
        F.max(F.when(F.col("surface") == F.col("lower"), F.col("cnt"))).alias("plain"),
        F.min(F.struct((-F.col("cnt")).alias("n"), "seen", "surface")).alias("b")
    )
    keep = (F.col("b.surface") != F.col("lower")) & (-F.col("b.n") > F.coalesce("plain", F.lit(0)))
    return best.select("lower", F.when(keep, F.col("b.surface")).otherwise(F.col("lower")).alias("surface"))


def apply_truecase(sents: DataFrame, truecase: DataFrame, capitalize_first: bool = False) -> DataFrame:
    """The sentences with each token's usual form. Sids are unique."""
    rows = _exploded(sents).join(truecase.withColumnRenamed("lower", "word"), "word", "left")
    w = F.coalesce("surface", "word")
    if capitalize_first:
        w = F.when((F.col("pos") == 0) & w.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)
    return _regrouped(sents, rows, w)


SPLIT_BUCKET_ROWS = 200_000


def assign_split(sents: DataFrame, fractions: tuple[tuple[str, float], ...] | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The sentences with split: sizes int(n * fraction), the rest to the last, in the order of md5(seed:sid); equal sids share a split.

    Only buckets of digests that a cut falls into are ranked, one row a bucket tells the others' side; the number of buckets follows the count.
    """
    fractions = fractions or (("train", cfg.train), ("dev", cfg.dev), ("test", cfg.test))
    if any(x < 0 for _, x in fractions) or abs(sum(x for _, x in fractions) - 1.0) > 1e-6:
        raise ValueError("split fractions must be 0 or more and sum to 1")
    digest = F.md5(F.concat(F.lit(f"{cfg.seed}:"), F.col("sid").cast("string")).cast("binary"))
    ids = materialize(sents.select("sid"))  # read several times
    n = ids.count()
    chars = 2
    while n / 16**chars > SPLIT_BUCKET_ROWS:
        chars += 1
    rows = ids.withColumn("__h", digest).withColumn("__b", F.substring("__h", 1, chars))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("c"))
    upto = sizes.select("__b", "c", F.sum("c").over(Window.orderBy("__b")).alias("upto"))  # one row a bucket
    cuts, cut = [], 0
    for _, share in fractions[:-1]:
        cut += int(n * share)
        cuts.append(cut)
    edge = []
    for cut in cuts:
        at = upto.where(f"upto >= {cut}").orderBy("__b").limit(1).select("__b", (F.lit(cut) - F.col("upto") + F.col("c")).alias("r"))
        own = rows.join(F.broadcast(at), "__b").select("__h", "r")  # one bucket's digests
        ranked = own.withColumn("k", F.row_number().over(Window.orderBy("__h")))
        edge.append(ranked.agg(F.coalesce(F.max(F.when(F.col("k") <= F.col("r"), F.col("__h"))), F.lit("")).alias("h")).first()["h"] if cut else "")
    out = None
    for (name, _), h in zip(fractions[:-1], edge, strict=True):
        hit = F.col("__h") <= h
        out = F.when(hit, name) if out is None else out.when(hit, name)
    last = F.lit(fractions[-1][0])
    return sents.withColumn("__h", digest).withColumn("split", last if out is None else out.otherwise(last)).drop("__h")


@dataclass
class Corpus:
    """A preprocessed corpus: sentences (sid, split, tokens), vocabulary (word, cnt, first_seen, in_vocab), truecase map (lower, surface)."""

    sentences: DataFrame
    vocab: DataFrame
    truecase: DataFrame

    def part(self, split: str) -> DataFrame:
        return self.sentences.where(F.col("split") == split)


def preprocess_corpus(sents: DataFrame, cfg: EngineConfig = DEFAULT, **overrides) -> Corpus:
    """Short sentences dropped, split, vocabulary and truecase map from the training split, words outside the vocabulary replaced."""
    cfg = cfg.override(**overrides) if overrides else cfg
    long = sents.where(F.size("tokens") >= cfg.min_sentence_tokens)
    split = assign_split(long.select("sid", "tokens"), cfg=cfg)
    train = split.where("split = 'train'")
    places = Places(train)
    vocab = materialize(build_vocab(train, cfg, places=places))
    return Corpus(apply_unk(split.select("sid", "split", "tokens"), vocab, cfg), vocab, truecase_map(train, places))


def preprocess(sents: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(sid, split, tokens) of the preprocessed corpus."""
    return preprocess_corpus(sents, cfg).sentences


def corpus_stats(sents: DataFrame) -> DataFrame:
    types = tokens(sents).groupBy("tok").agg(F.count("*").alias("c"))
    t = types.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("hapax"))
    s = sents.agg(F.count("*").alias("sentences"))
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return s.crossJoin(t).select(
        "sentences", "tokens", "types", div("types", "tokens").alias("ttr"), "hapax", div("hapax", "types").alias("hapax_ratio"),
        div("tokens", "sentences").alias("mean_len")
    )


def frequency_table(sents: DataFrame, top: int = 20) -> DataFrame:
    v = tokens(sents).groupBy("tok").agg(F.count("*").alias("cnt"), first_seen().alias("s"))
    return v.orderBy(F.col("cnt").desc(), "s").limit(top).select("tok", "cnt")


def zipf_points(sents: DataFrame) -> DataFrame:
    """(rank, cnt) of all types; ties share their counts, so ranks need only the histogram of counts."""
    hist = tokens(sents).groupBy("tok").agg(F.count("*").alias("cnt")).groupBy("cnt").agg(F.count("*").alias("n"))
    hist = hist.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("cnt").desc())))  # one row for each distinct count
    return hist.select(F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("rank"), "cnt")


def coverage_curve(sents: DataFrame, steps=(100, 1000, 5000, 20000)) -> DataFrame:
    """(top, coverage): the share of tokens that the most frequent types cover; the first step beyond all types ends it."""
    hist = tokens(sents).groupBy("tok").agg(F.count("*").alias("cnt")).groupBy("cnt").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("cnt").desc())
    hist = hist.withColumn("types", F.sum("n").over(w)).withColumn("mass", F.sum(F.col("n") * F.col("cnt")).over(w))
    total = hist.agg(F.max("types").alias("all_types"), F.max("mass").alias("all_mass"))
    st = hist.sparkSession.createDataFrame([(s, ([0, *steps])[i]) for i, s in enumerate(steps)], "step bigint, prev bigint")
    rows = st.crossJoin(total).where(F.col("prev") <= F.col("all_types")).withColumn("top", F.least("step", "all_types"))
    hit = rows.join(hist, (F.col("types") - F.col("n") < F.col("top")) & (F.col("types") >= F.col("top")))
    return hit.select("top", ((F.col("mass") - (F.col("types") - F.col("top")) * F.col("cnt")) / F.col("all_mass")).alias("coverage"))


def oov_rate(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    kept = vocab.where("in_vocab").select("word", F.lit(0).alias("known"))
    t = tokens(sents).withColumn("word", F.lower("tok")).join(kept, "word", "left")
    return t.agg(F.coalesce(F.avg(F.coalesce("known", F.lit(1)).cast("double")), F.lit(0.0)).alias("oov_rate"))

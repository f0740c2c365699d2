"""Tables on shared storage: intermediate results that cut lineage, and saved models, taggers, corpora and user profiles."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT, EngineConfig

_OWN: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder only where that is unset and one machine runs all, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        own = tempfile.mkdtemp(prefix="foresail-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN.append("file://" + own)
    return _OWN[0]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def state_of(spark: SparkSession, path: str) -> tuple:
    """(name, bytes, time of change) of a table's files, to tell whether it is still the same."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return ()
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p)))


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: plans stay small, and lost executors cost nothing that is done."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables that materialize() has written in this process; results not yet read are then gone."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())


def _write_meta(spark: SparkSession, path: str, **values) -> None:
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


# --- language models


def save_model(model, path: str) -> None:
    """Base counts and the vocabulary; everything else is derived again on loading."""
    model.grams.write.mode("overwrite").partitionBy("k").parquet(f"{path}/grams")
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    _write_meta(model.grams.sparkSession, path, order=model.order, config=asdict(model.cfg))


def load_model(spark: SparkSession, path: str, cfg: EngineConfig | None = None):
    """The model with the settings it was saved with, unless others are given."""
    from ..operators.lm import NgramModel

    meta = _read_meta(spark, path)
    return NgramModel(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/vocab"), meta["order"], cfg or EngineConfig(**meta["config"]))


# --- taggers


def save_tagger(tagger, path: str) -> None:
    """Counts, not logarithms: another smoothing constant needs no second fit."""
    tagger.tag_counts.write.mode("overwrite").parquet(f"{path}/tags")
    tagger.transitions.write.mode("overwrite").parquet(f"{path}/transitions")
    tagger.emissions.write.mode("overwrite").parquet(f"{path}/emissions")
    _write_meta(tagger.emissions.sparkSession, path, config=asdict(tagger.cfg))


def load_tagger(spark: SparkSession, path: str, cfg: EngineConfig | None = None):
    from ..operators.hmm import HMMTagger

    cfg = cfg or EngineConfig(**_read_meta(spark, path)["config"])
    return HMMTagger.from_counts(*(spark.read.parquet(f"{path}/{name}") for name in ("tags", "transitions", "emissions")), cfg).load()


# --- corpora


def save_corpus(corpus, path: str) -> None:
    """A preprocessed corpus: sentences by split, vocabulary and truecase map."""
    corpus.sentences.write.mode("overwrite").partitionBy("split").parquet(f"{path}/sentences")
    corpus.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    corpus.truecase.write.mode("overwrite").parquet(f"{path}/truecase")


def load_corpus(spark: SparkSession, path: str):
    from ..operators.corpus import Corpus

    return Corpus(*(spark.read.parquet(f"{path}/{name}") for name in ("sentences", "vocab", "truecase")))


# --- user profiles

_PROFILE = "user bigint, seq bigint, tokens array<string>"


class ProfileStore:
    """Profiles of all users in a folder: appended batches of sentences, and the settings they are read with.

    Batches belong to a generation; a reset writes the next one and moves the pointer last, so readers see either state whole.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: EngineConfig = DEFAULT):
        self.spark, self.path, self.cfg, self.generation = spark, path, cfg, 0

    @classmethod
    def load(cls, spark: SparkSession, path: str, cfg: EngineConfig | None = None) -> ProfileStore:
        """The stored profiles; without a stored one, an empty store."""
        if not exists(spark, f"{path}/meta"):
            return cls(spark, path, cfg or DEFAULT)
        meta = _read_meta(spark, path)
        store = cls(spark, path, cfg or EngineConfig(**meta["config"]))
        store.generation = meta["generation"]
        return store

    def _save_meta(self) -> None:
        _write_meta(self.spark, self.path, generation=self.generation, config=asdict(self.cfg))

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows-{self.generation}"

    def observed(self) -> DataFrame:
        """(user, seq, tokens) of all that was observed and not forgotten."""
        if not exists(self.spark, self._rows):
            return self.spark.createDataFrame([], _PROFILE)
        return self.spark.read.schema(_PROFILE).parquet(self._rows)

    def observe(self, sents: DataFrame) -> DataFrame:
        """Appends sentences (user, seq, tokens); (user, tokens) that were added."""
        from ..operators.profile import observed

        new = materialize(observed(sents))
        new.select("user", "seq", "tokens").write.mode("append").parquet(self._rows)
        self._save_meta()
        return new.groupBy("user").agg(F.sum(F.size("tokens")).alias("tokens"))

    def observe_texts(self, texts: DataFrame) -> DataFrame:
        """Cleans, splits and tokenizes texts (user, seq, text), then observes their sentences in order."""
        from ..functions import text as T

        rows = T.normalize_nfc(texts.select("user", "seq", "text"), "text")
        rows = rows.select("user", "seq", F.posexplode(T.split_sentences(T.clean_text(F.col("text")))).alias("si", "s"))
        return self.observe(
            rows.select("user", (F.col("seq") * 100_000 + F.col("si")).cast("bigint").alias("seq"), T.tokenize(F.col("s")).alias("tokens"))
        )

    def retained(self) -> DataFrame:
        from ..operators.profile import retained

        return retained(self.observed(), self.cfg.profile_cap)

    def compact(self) -> None:
        """Keeps retained sentences alone, as a saved profile does: the vocabulary is then of these."""
        self._replace(self.retained())

    def reset(self, users: DataFrame | None = None) -> None:
        """Forgets the given users (user), or all."""
        self._replace(self.observed().limit(0) if users is None else self.observed().join(users.select("user").distinct(), "user", "left_anti"))

    def _replace(self, rows: DataFrame) -> None:
        old = self._rows
        rows.select("user", "seq", "tokens").write.mode("overwrite").parquet(f"{self.path}/rows-{self.generation + 1}")
        self.generation += 1
        self._save_meta()
        delete(self.spark, old)


def load_predictor(
    spark: SparkSession, model_path: str, corpus_path: str | None = None, profile_path: str | None = None, tagger_path: str | None = None, **overrides
):
    """A predictor from saved parts: the model with its lexicon, and where given the truecase map of a corpus, user profiles and a tagger."""
    from ..operators import lexicon, predict, profile

    model = load_model(spark, model_path)
    cfg = model.cfg.override(**overrides) if overrides else model.cfg
    words = model.grams.where("k = 1").where(~F.col("word").isin(cfg.bos, cfg.eos, cfg.unk))
    store = ProfileStore.load(spark, profile_path) if profile_path else None
    users = {}
    if store:
        kept = store.retained()
        users = {
            "grams": profile.user_grams(kept, store.cfg), "user_words": profile.user_words(store.observed()),
            "user_stats": profile.stats(store.observed(), store.cfg)
        }
    return predict.Predictor(
        model, lexicon.words_of_counts(words.select("word", "cnt")), truecase=load_corpus(spark, corpus_path).truecase if corpus_path else None,
        tagger=load_tagger(spark, tagger_path) if tagger_path else None, cfg=cfg, **users,
    )

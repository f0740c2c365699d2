"""Loading of corpora: text files, tables and tagged corpora, each as sentence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import corpus, hmm
from .bundle import exists
from .conll import read_conll

TAGGED = ("sid", "pos", "word", "tag")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, text) of text files, each read whole; doc_id is a digest of the file's path, so it doesn't depend on how files are dealt."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return rows.select(F.pmod(F.xxhash64("file"), F.lit(1 << 40)).alias("doc_id"), "file", "text")


def _documents(spark: SparkSession, source: str) -> DataFrame | None:
    if spark.catalog.tableExists(source) if "/" not in source else False:
        return spark.table(source)
    if not exists(spark, source):
        return None
    return spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else read_text_files(spark, source)


def load_sentences(spark: SparkSession, source: str, limit: int | None = None, fallback: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Sentences (sid, ..., tokens) of a source: the name of a table, a Parquet table, or a text file or folder of them.

    Tables have (id, text). A source that isn't there is replaced by the fallback; without one it is an error.
    """
    for name in (source, fallback):
        docs = _documents(spark, name) if name else None
        if docs is not None:
            sents = corpus.sentences(docs, id_col)
            return sents.orderBy("sid").limit(limit) if limit else sents
    raise FileNotFoundError(f"no table, file or folder named {source!r}, and no usable fallback")


def load_tagged(spark: SparkSession, source: str, limit: int | None = None, fallback: str | None = None) -> DataFrame:
    """Cleaned tagged sentences (sid, pos, word, tag) of a table with these columns or of two-column files; with the same fallback rule."""
    for name in (source, fallback):
        if not name:
            continue
        if "/" not in name and spark.catalog.tableExists(name):
            rows = spark.table(name).select(*TAGGED)
        elif not exists(spark, name):
            continue
        elif name.rstrip("/").endswith(".parquet"):
            rows = spark.read.parquet(name).select(*TAGGED)
        else:
            rows = read_conll(spark, name)
            sid = F.pmod(F.xxhash64("file"), F.lit(1 << 40)) * 1_000_000 + F.col("sent")
            rows = rows.select(sid.alias("sid"), "pos", "word", "tag")
        if limit:
            rows = rows.join(rows.select("sid").distinct().orderBy("sid").limit(limit), "sid", "left_semi")
        return hmm.clean_tagged(rows)
    raise FileNotFoundError(f"no tagged table or file named {source!r}, and no usable fallback")

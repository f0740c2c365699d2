"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.bundle import shared_dir

BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: Arrow batches of this session get at most BATCH_ROWS of them, which bounds memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's own reader so that any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables written to the shared folder. They cut lineage, outlive lost executors, and can be dropped."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of [^\\x20\\x09-\\x0D], as UTF-8: bytes.split() splits at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pieces(batches, rows: int = 512):
    """Arrow batches in slices of a few rows, so that Python objects of one slice alone are in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def join_many(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table that grows with the input. Neither is broadcast: the planner goes by the size of files, in which repeated
    values take next to nothing, and each broadcast's rows would be on the driver's heap."""
    return rows.join(other.hint("merge"), on, how)


#: a table of verdicts is broadcast up to this many rows, after a count
FEW_ROWS = 100_000
SALTS = 32


def join_few(rows: DataFrame, few: DataFrame, on: str, spread: str, how: str = "left") -> DataFrame:
    """rows joined with a saved table that has one row a key. Few are broadcast; more meet the rows by key and salt, so a hot key is many tasks' work.

    The salted copies are SALTS times what the planner takes from the size of few's files, so they are never left to its threshold for broadcasts.
    """
    if few.count() <= FEW_ROWS:
        return rows.join(F.broadcast(few), on, how)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_many(rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")), salted, [on, "__salt"], how).drop("__salt")

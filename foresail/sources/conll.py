"""Tagged text in two columns: a word and a tag on a line, a blank line after each sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def _pairs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line, sent, word, tag): comments and lines without two parts are skipped; a tab splits first, else the last blank."""
    rows = df.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw"))
    blank = F.trim("raw") == ""
    w = Window.partitionBy(*keys).orderBy("line")
    rows = rows.withColumn("sent", F.sum(blank.cast("long")).over(w)).where(~blank & ~F.startswith("raw", F.lit("#")))
    raw = F.rtrim("raw")
    tab = F.split(raw, "\t")
    one = F.array(F.regexp_extract(raw, r"^(.*) ([^ ]*)$", 1), F.regexp_extract(raw, r"^(.*) ([^ ]*)$", 2))
    parts = F.when(F.contains("raw", F.lit("\t")), tab).when(raw.rlike(" "), one)
    return rows.withColumn("p", parts).where(F.size("p") == 2).select(*keys, "line", "sent", F.get("p", 0).alias("word"), F.get("p", 1).alias("tag"))


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """(sid, pos, word, tag) from rows (sid, block) of one sentence each."""
    rows = _pairs(blocks, ["sid"], "block")
    return rows.select("sid", (F.row_number().over(Window.partitionBy("sid").orderBy("line")) - 1).alias("pos"), "word", "tag")


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, pos, word, tag); each file is read whole, for its lines have an order."""
    rows = _pairs(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), ["file"], "value")
    return rows.select("file", "sent", (F.row_number().over(Window.partitionBy("file", "sent").orderBy("line")) - 1).alias("pos"), "word", "tag")


def write_conll(tagged: DataFrame, path: str) -> None:
    """Sentences (sid, pos, word, tag) in order of sid, a blank line after each."""
    block = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "word", "tag"))), lambda x: F.concat(x["word"], F.lit("\t"), x["tag"])), "\n"
    )
    tagged.groupBy("sid").agg(block.alias("value")).orderBy("sid").select("value").write.option("lineSep", "\n\n").mode("overwrite").text(path)

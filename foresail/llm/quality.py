"""Quality rules with verdicts on hosts.

Each text is measured once; a document fails on its own if it is too short or mostly repeats itself. Failures are summed by
host, each host's rate is shrunk towards the corpus by a beta prior whose two parameters are fitted to all hosts by moments, and
hosts whose shrunken rate is above a limit lose their other documents too. Sums by host are partial aggregates, so a
host with a third of all rows costs no more than another; only rejected hosts are joined back.

Null and empty texts have no words and fail. A null host is no host: its documents are judged on their own. Repeated rows and ids have a row each and
count each; ties can't matter. Very long texts are measured whole. Other columns are carried by number, so their names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, join_few, pieces, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    _, pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line and line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), dups, repeat_words(words)


def _measured(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns to keep (by number: names may clash) with the measures and base_failed."""
    slim = df.select(df[text_col].alias("text"), *[df[c].alias(f"keep{i}") for i, c in enumerate(keep)])

    def run(batches):
        for batch in pieces(batches):
            rows = [measure(t) for t in batch.column(0).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *cols], [*batch.schema.names[1:], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            )

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.schema.fields[1:])
    out = slim.mapInArrow(run, kinds + STATS)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(rows: DataFrame, host_col: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_rejected) from rows with base_failed; the prior is fitted over all hosts."""
    hosts = rows.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    p = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        F.avg(p).alias("m"), F.coalesce(F.var_pop(p), F.lit(0.0)).alias("v"), F.avg(F.lit(1.0) / F.col("n_docs")).alias("inv")
    )
    # moments of a beta-binomial: the variance of the rates less what sampling alone gives
    between = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.lit(1e-6))
    strength = F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(1.0))
    prior = prior.select((F.col("m") * strength).alias("a"), strength.alias("s"))
    rated = hosts.crossJoin(F.broadcast(prior))  # the prior is one row by construction
    rate = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("s"))
    return rated.select("host", "n_docs", "n_failed", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected"))


def quality_rules(df: DataFrame, id_col: str, text_col: str, host_col: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(id, measures, base_failed, kept) for every row."""
    spark = df.sparkSession
    sc = Scratch(spark, "quality")
    rows = sc.save(_measured(df, text_col, [id_col, host_col]), "rows")
    hosts = sc.save(host_verdicts(rows, "keep1", max_rate).where("host_rejected").select(F.col("host").alias("keep1"), "host_rejected"), "hosts")
    kept = ~F.col("base_failed") & F.col("host_rejected").isNull()
    return join_few(rows, hosts, "keep1", "keep0").select(
        F.col("keep0").alias("id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )


def keep_good(df: DataFrame, text_col: str, host_col: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows that pass, with their columns; measures are taken twice rather than texts stored in between."""
    spark = df.sparkSession
    hosts = Scratch(spark, "quality").save(host_verdicts(_measured(df, text_col, [host_col]), "keep0", max_rate).where("host_rejected"), "hosts")
    at = df.columns.index(text_col)

    def run(batches):
        for batch in pieces(batches):
            ok = []
            for t in batch.column(at).to_pylist():
                n, _, _, _, rep = measure(t)
                ok.append(not (n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n))
            yield batch.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(run, df.schema).join(hosts.select(F.col("host").alias("__host")), F.col(host_col) == F.col("__host"), "left_anti")

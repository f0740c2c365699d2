"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts whose label isn't looked at are the unlabelled. A linear classifier over
the rates of words and of word beginnings of 4 to 6 letters (stems of words that the positives have in other forms) is trained in numpy on the risk  p R+(positives) + max(0, R-(unlabelled) - p R-(positives)),  p the class prior,
with the corrected gradient step where the bracket turns negative. The prior is the share of toxic labels in the training folds.

Training takes at most ``max_positive`` and ``max_unlabelled`` distinct rows, those with the smallest hash of id and text; every text is scored whole.
Labels are learnt only from rows whose crc32(id as text) mod 4 is not 2. Nulls and empty texts get the score of a text
without words. Without positives the score is 0 everywhere. Repeated ids: each row is scored; of conflicting labels the largest counts. Ties of the hash go by
id. Other columns of documents or labels are not read, so their names can't clash. An empty table of documents gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, pieces

MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
MIN_TEXTS = 3
MAX_WORDS = 50_000
MIN_Z = 3.0
THRESHOLD = 0.3
FOLDS, HELD = 4, 2
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, known: dict | None = None) -> dict[str, float]:
    """Words and word beginnings (marked by a dash) of a whole text, or those known, with log(1 + count in a hundred words)."""
    words = _WORD.findall(text.lower()) if text else []
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        counts[word] += n
        for k in STEMS:
            if len(word) > k:
                counts[word[:k] + "-"] += n
    return {x: math.log1p(100 * n / len(words)) for x, n in counts.items() if known is None or x in known}


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(
    positive: list[list[tuple[int, float]]], unlabelled: list[list[tuple[int, float]]], n_words: int, prior: float, steps: int = 400,
    rate: float = 0.05, decay: float = 1e-3, beta: float = 0.0
) -> tuple[np.ndarray, float]:
    """Weights and intercept from rows of (feature, value); Adam on the corrected risk with the logistic loss, full batches."""
    rows = positive + unlabelled
    n_p, n_u = len(positive), len(unlabelled)
    lengths = np.array([len(r) for r in rows])
    idx = np.fromiter((i for r in rows for i, _ in r), dtype=np.int64, count=int(lengths.sum()))
    value = np.fromiter((v for r in rows for _, v in r), dtype=np.float64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    for t in range(1, steps + 1):
        s = _sigmoid(np.bincount(owner, w[idx] * value, minlength=len(rows)) + b)
        sp, su = s[:n_p], s[n_p:]
        # logistic loss: positive part has slope s - 1, negative part has slope s
        negative = -np.log1p(-np.clip(su, 0, 1 - 1e-12)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-12)).mean()
        if negative < -beta:
            g = np.concatenate([prior * sp / n_p, -su / n_u])  # the step back of the correction
        else:
            g = np.concatenate([prior * (sp - 1) / n_p - prior * sp / n_p, su / n_u])
        gw = np.bincount(idx, g[owner] * value, minlength=n_words) + decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED
) -> tuple[dict[str, float], float] | None:
    """Word weights and the intercept, from a bounded sample; None without positives."""
    ids = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")
    ).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p"), F.count("*").alias("n")).first()
    if not share.n or not share.p:
        return None
    toxic = ids.select("id", "h").distinct().join(known.where("toxic = 1").select("id"), "id").orderBy("h", "id").limit(max_positive)
    sample = ids.select("id", "h").distinct().orderBy("h", "id").limit(max_unlabelled)
    chosen = toxic.select("id", "h", F.lit(1).alias("y")).unionByName(sample.select("id", "h", F.lit(0).alias("y")))  # bounded by the two limits
    own = ids.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h", "y").agg(F.first("text").alias("text"))  # equal rows count once

    def words(batches):
        for batch in pieces(batches):
            found = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.string())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.float64()))
                ],
                ["y", "words", "rates"]
            )

    got = Scratch(docs.sparkSession, "toxicity").save(
        own.select("text", "y").mapInArrow(words, "y int, words array<string>, rates array<double>"), "sample"
    )
    n = {r.y: r.n for r in got.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = n.get(1, 0), n.get(0, 0)
    if not n_p or not n_u:
        return None
    # words that positives have more often than unlabelled texts, by MIN_Z standard errors; the driver gets these alone
    p, u = F.col("p") / n_p, F.col("u") / n_u
    q = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (p - u) / F.sqrt(q * (1 - q) * (1 / n_p + 1 / n_u))
    counts = got.select("y", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("u")
    )
    chosen_words = counts.withColumn("z", z).where(
        (F.col("p") >= min(MIN_TEXTS, n_p)) & (F.col("z") >= MIN_Z)
    ).orderBy(F.col("z").desc(), "word").limit(MAX_WORDS)
    vocab = [r.word for r in chosen_words.select("word").collect()]
    index = {x: i for i, x in enumerate(vocab)}

    def code(batches):
        for batch in pieces(batches):
            rows = [
                sorted((index[x], v) for x, v in zip(a, b, strict=True) if x in index) for a,
                b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([[i for i, _ in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([[v for _, v in r] for r in rows], pa.list_(pa.float64()))
                ],
                ["y", "ids", "rates"]
            )

    rows = got.mapInArrow(code, "y int, ids array<int>, rates array<double>").collect()
    coded = {
        y: sorted(list(zip(r.ids, r.rates, strict=True)) for r in rows if r.y == y) for y in (0, 1)
    }  # sorted: sums don't depend on the order of tasks
    w, b = fit_nnpu(coded[1], coded[0], len(vocab), min(max(share.p, 1e-3), 0.999))
    return {x: float(w[i]) for x, i in index.items()}, b


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""
    model = train(docs, labels, id_col, text_col)

    def run(batches):
        weights, b = model or ({}, None)
        for batch in pieces(batches):
            z = [
                math.fsum(
                    [b, *(weights[x] * v for x, v in features(t, weights).items())]
                ) if b is not None else -np.inf for t in batch.column(1).to_pylist()
            ]
            s = _sigmoid(np.array(z, dtype=np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

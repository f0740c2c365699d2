"""User profiles as keyed streaming state: sentences arrive, the oldest go beyond the cap; statistics or changes of counts come out."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, EngineConfig

OUT = "user bigint, tokens bigint, sentences bigint, vocabulary bigint, weight double"
CHANGES = "user bigint, k int, ctx array<string>, word string, delta bigint"


def _arrive(kept: list, frames, cap: int) -> tuple[list, list, list]:
    """(kept, came, went): sentences of one batch in order of seq, and those that the cap pushes out."""
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    came = [low for low in ([t.lower() for t in tokens if t] for tokens in rows["tokens"] if tokens is not None) if low]
    kept = kept + came
    total, first = sum(map(len, kept)), 0
    while cap and total > cap and first < len(kept):
        total -= len(kept[first])
        first += 1
    return kept[first:], came, kept[:first]


def profile_stream(sents: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(user, tokens, sentences, vocabulary, weight) after each batch, from a stream (user, seq, tokens).

    State by user: retained sentences and all words ever seen. Of one batch, sentences arrive in order of seq.
    """
    cap, growth, top = cfg.profile_cap, cfg.growth_tokens, cfg.lambda_max

    def update(key, frames, state: GroupState):
        kept, words = map(json.loads, state.get) if state.exists else ([], [])
        kept, came, _ = _arrive(kept, frames, cap)
        words = set(words).union(*came)
        state.update((json.dumps(kept), json.dumps(sorted(words))))
        total = sum(map(len, kept))
        weight = top if not growth else top * min(1.0, total / growth)
        yield pd.DataFrame([(key[0], total, len(kept), len(words), weight)], columns=["user", "tokens", "sentences", "vocabulary", "weight"])

    return sents.groupBy("user").applyInPandasWithState(update, OUT, "kept string, words string", "update", GroupStateTimeout.NoTimeout)


def gram_changes(sents: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(user, k, ctx, word, delta) of each batch, from a stream (user, seq, tokens): grams of arriving sentences are added, those of evicted
    ones taken away. State by user is the retained sentences alone; counts live in the sink, where deltas add up (see current_grams)."""
    n, bos, eos, cap = cfg.order, cfg.bos, cfg.eos, cfg.profile_cap

    def grams(tokens: list[str]):
        p = [bos] * (n - 1) + tokens + [eos]
        return ((k, tuple(p[i - k + 1 : i]), p[i]) for i in range(n - 1, len(p)) for k in range(1, n + 1))

    def update(key, frames, state: GroupState):
        kept = json.loads(state.get[0]) if state.exists else []
        kept, came, went = _arrive(kept, frames, cap)
        state.update((json.dumps(kept),))
        change: Counter = Counter()
        for sign, part in ((1, came), (-1, went)):
            for tokens in part:
                for g in grams(tokens):
                    change[g] += sign
        rows = [(key[0], k, list(ctx), word, d) for (k, ctx, word), d in change.items() if d]
        yield pd.DataFrame(rows, columns=["user", "k", "ctx", "word", "delta"])

    return sents.groupBy("user").applyInPandasWithState(update, CHANGES, "kept string", "append", GroupStateTimeout.NoTimeout)


def current_grams(changes: DataFrame) -> DataFrame:
    """(user, k, ctx, word, cnt) from all changes that a stream has written; grams whose count is gone are left out."""
    return changes.groupBy("user", "k", "ctx", "word").agg(F.sum("delta").alias("cnt")).where("cnt > 0")

"""Secret scans: three patterns, and a token-efficiency test that exposes random strings.

A run of 20 or more token characters whose characters per token under a tiktoken vocabulary fall below a ratio is
random-looking: words and identifiers of languages merge into long tokens, keys don't. Known digests (pure hexadecimal), UUIDs,
plain numbers and identifiers of one letter case without digits, in words of fewer than 20 letters, are excluded. What a pattern has found already is cut out of a run, and each
part that is left is tested by itself if it has 20 or more characters.

Null texts are empty and have no spans. Each input row has one output row, repeated rows and ids too. Offsets are code points. Very long texts are read whole.
Spans that start at one place go by kind. Other columns are not read, so their names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

MIN_RUN = 20
MAX_CHARS_PER_TOKEN = 2.0

_ANY = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)  # noqa: E731  letters in either case, ASCII only
ASSIGN = re.compile("(?:" + "|".join([*map(_ANY, ("password", "passwd", "secret", "token")), _ANY("api") + "_?" + _ANY("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal, so a shorter one can hide none
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
KINDS = ("assign", "access", "hex", "entropy")

_DIGEST = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_PLAIN = re.compile(r"[A-Za-z][a-z]*(?:[_/+=-]+[A-Za-z]?[a-z]*)*|[A-Z_/+=-]+|[0-9_/+=-]+")
_LONG = re.compile(r"[A-Za-z]{%d}" % MIN_RUN)


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _rest(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) that no span covers."""
    out = []
    for a, _, b in sorted(x for x in spans if x[0] < end and start < x[2]):
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def find_spans(text: str | None, enc, max_ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end), sorted."""
    if not text:
        return []
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = []
    for m in RUN.finditer(text):
        for a, b in _rest(m.start(), m.end(), base):
            run = text[a:b]
            if b - a < MIN_RUN or _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or (_PLAIN.fullmatch(run) and not _LONG.search(run)):
                continue
            if len(run) < max_ratio * len(enc.encode_ordinary(run)):
                more.append((a, 3, b))
    return sorted(base + more)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_col: str, text_col: str, vocab_path: str, pattern: str, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for every row."""

    def run(batches):
        enc = _vocabulary(vocab_path, pattern)
        for batch in pieces(batches):
            rows = [find_spans(t, enc, max_ratio) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in r) for r in rows], pa.int64()) for i in range(4)]
            sha = [hashlib.sha256(_joined(s for s in r if s[1] < 3).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(list(map(_joined, rows)), pa.string())],
                ["id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"
    )


def redact_secrets(
    df: DataFrame, text_col: str, vocab_path: str, pattern: str, mark: str = "[SECRET]", max_ratio: float = MAX_CHARS_PER_TOKEN
) -> DataFrame:
    """The same rows and columns with every span of the text replaced by a mark; texts without spans stay as they are."""
    at = df.columns.index(text_col)

    def clean(text, enc):
        out, done = [], 0
        for a, _, b in find_spans(text, enc, max_ratio):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        enc = _vocabulary(vocab_path, pattern)
        for batch in pieces(batches):
            texts = pa.array([clean(t, enc) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)

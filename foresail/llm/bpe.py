"""Byte-pair encoding and decoding of whole texts by tree concatenation.

A text longer than ``leaf_chars`` is halved until its pieces are short enough, the pieces are encoded in a pool
of threads, and neighbours are joined bottom-up. A half was encoded without its neighbour, so at each join a window of text
around the cut is encoded again and grows until it reaches, on either side, a place where the pre-tokenizer must
break whatever stands around it and where the re-encoded tokens agree with the half's own. What lies outside
the window is then what one encoding of the whole text gives.

Nulls and empty texts: no tokens, the decoded text is empty. Repeated rows and ids: one output row for each input row.
A special token's string in a text is that token, as the tokenizers library has it. Other columns are not read, so their names can't clash. Ties can't matter.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from concurrent.futures import ThreadPoolExecutor
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

LEAF_CHARS = 1 << 15
WINDOW_CHARS = 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 and on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(c: str) -> str:
    """'L' letter, 'N' number, 'O' other mark; nothing for white space and for what tables of characters may not agree on."""
    if c.isascii():
        return "" if c.isspace() else "L" if c.isalpha() else "N" if c.isdigit() else "O"
    kind = unicodedata.category(c)
    return "" if c.isspace() or kind[0] in "CMZ" or c >= "\U00010000" else kind[0] if kind[0] in "LN" else "O"


class TreeEncoder:
    """encode() and decode() of one byte-level vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text in self.special:
            ranks.pop(text.encode(), None)
        self.enc = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.leaf_chars, self.window_chars = max(2, leaf_chars), max(2, window_chars)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        found = [s for s in self.special if s in text]
        if not found:
            return self._plain(text)
        mark = min(found, key=lambda s: (text.index(s), -len(s)))
        before, _, after = text.partition(mark)
        out: list[int] = []
        while True:  # a loop, for a text may repeat the mark any number of times
            out += self.encode(before) if len(found) > 1 else self._plain(before)
            out.append(self.special[mark])
            if mark not in after:
                return out + (self.encode(after) if len(found) > 1 else self._plain(after))
            before, _, after = after.partition(mark)

    def decode(self, ids: list[int]) -> str:
        return self.enc.decode_bytes(ids).decode("utf-8", "replace")

    def _plain(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.enc.encode_ordinary(text)
        n = 2
        while len(text) / n > self.leaf_chars:
            n *= 2
        cuts = [len(text) * i // n for i in range(n + 1)]
        with ThreadPoolExecutor(2) as pool:
            parts = list(pool.map(lambda i: self.enc.encode_ordinary(text[cuts[i] : cuts[i + 1]]), range(n)))
        step = 1
        while step < n:
            for i in range(0, n, 2 * step):
                parts[i] = self._join(text, cuts[i], cuts[i + step], cuts[i + 2 * step], parts[i], parts[i + step])
            step *= 2
        return parts[0]

    @staticmethod
    def _sure(text: str, i: int) -> bool:
        """The pre-tokenizer always breaks there and starts afresh: before a blank between two marks, and where letters, digits and other
        marks meet, but for an apostrophe, which may begin a short form."""
        before, here = _kind(text[i - 1]), _kind(text[i])
        if text[i] == " ":
            return bool(before) and bool(_kind(text[i + 1]))
        return bool(before) and bool(here) and before != here and text[i - 1] != "'"

    def _join(self, text: str, a: int, cut: int, b: int, left: list[int], right: list[int]) -> list[int]:
        ends_l, ends_r = self._ends(left), self._ends(right)
        grow = self.window_chars
        while True:
            lo, hi = cut - grow, cut + grow
            lo = next((i for i in range(max(lo, a + 2), max(lo - grow, a + 1), -1) if self._sure(text, i)), None) if lo > a + 1 else a
            hi = next((i for i in range(min(hi, b - 2), min(hi + grow, b - 1)) if self._sure(text, i)), None) if hi < b - 2 else b
            if lo is not None and hi is not None:
                window = self.enc.encode_ordinary(text[lo:hi])
                nl = self._tokens_before(text, a, lo, ends_l)
                nr = self._tokens_before(text, cut, hi, ends_r)
                if nl is not None and nr is not None and self._agree(window, left[nl:], right[:nr], lo == a, hi == b):
                    return left[:nl] + window + right[nr:]
            if cut - grow <= a and cut + grow >= b:
                return self.enc.encode_ordinary(text[a:b])
            grow *= 2

    def _ends(self, ids: list[int]) -> np.ndarray:
        lengths = np.fromiter((len(self.enc.decode_single_token_bytes(i)) for i in ids), dtype=np.int64, count=len(ids))
        return np.cumsum(lengths)

    @staticmethod
    def _tokens_before(text: str, start: int, at: int, ends: np.ndarray) -> int | None:
        """How many tokens end at or before a place of the text, if one ends exactly there."""
        want = len(text[start:at].encode("utf-8", "surrogatepass"))
        if want == 0:
            return 0
        k = bisect_left(ends, want)
        return k + 1 if k < len(ends) and ends[k] == want else None

    @staticmethod
    def _agree(window: list[int], old_left: list[int], old_right: list[int], whole_left: bool, whole_right: bool) -> bool:
        """The first and last tokens of the window are those of the halves; a half that is wholly inside has no say."""
        return (whole_left or window[:1] == old_left[:1]) and (whole_right or window[-1:] == old_right[-1:])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS) -> TreeEncoder:
    return TreeEncoder(path, pattern, leaf_chars, window_chars)


def bpe_encode(
    df: DataFrame, id_col: str, text_col: str, vocab_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, decode: bool = True
) -> DataFrame:
    """(id, ids array<int>, decoded string) for every row, the last only if asked for; a null or empty text has no ids."""

    def run(batches):
        tree = encoder(vocab_path, pattern, leaf_chars)
        for batch in pieces(batches):
            ids, decoded = [], []
            for t in batch.column(1).to_pylist():
                own = tree.encode(t)
                if decode:
                    decoded.append(tree.decode(own))
                ids.append(np.asarray(own, dtype=np.int32))
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
            yield pa.RecordBatch.from_arrays(
                [*columns, *([pa.array(decoded, pa.string())] if decode else [])], ["id", "ids", "decoded"][: 2 + decode]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decode)


def bpe_digests(df: DataFrame, id_col: str, text_col: str, vocab_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """As bpe_encode, with digests in place of ids and texts: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        tree = encoder(vocab_path, pattern, leaf_chars)
        for batch in pieces(batches):
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = tree.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(tree.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

"""Column builders for text: cleaning, sentences, tokens, buffers, word shapes. The same patterns serve DuckDB oracles."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Character classes and patterns of the tokenizer, in a spelling that Java and RE2 share.
MARKS = r"\x{0300}-\x{036f}\x{0900}-\x{0903}\x{093a}-\x{094f}\x{0951}-\x{0957}\x{0962}-\x{0963}"
LETTER = rf"[\p{{L}}\p{{Nl}}\p{{No}}{MARKS}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN = rf"{LETTER}+(?:['’-]{LETTER}+)*|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|[^\p{{L}}\p{{N}}_\s]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EMAIL = r"\b[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+\b"
URL = r"\b(?:https?://|www\.)\S+\b|\b\S+\.(?:com|org|net|io|edu)\S*"
SPACE = r"[\s\x{0085}\p{Z}]+"
CURLY, STRAIGHT = "‘’“”–— ", "''\"\"-- "
SENTENCE_END = r"([.!?।॥])\s+"
CONTRACTIONS = (r"\b(can)(not)\b", rf"({WORD_CHAR})(n['’]t)\b", rf"({WORD_CHAR})(['’](?:s|re|ve|ll|d|m))\b")
PUNCTUATION = r"^[^\p{L}\p{N}_]+$"
# The same tokens and blanks without what costs time in Java: possessive, ASCII letters first; and no single blank replaced by a blank.
_LETTERS = rf"(?:[a-zA-Z]++|{LETTER}++)++"
FAST_TOKEN = rf"{_LETTERS}(?:['’-]{_LETTERS})*+|\p{{Nd}}++(?:[.,]\p{{Nd}}++)*+|[^\p{{L}}\p{{N}}_\s]"
FAST_SPACE = r"[\s\x{0085}\p{Z}&&[^ ]][\s\x{0085}\p{Z}]*+| [\s\x{0085}\p{Z}]++"
#: what every match of URL has in it, in all forms of a letter that Java takes as equal
URL_PART = r"://|[wW]{3}\.|\.(?:[cC][oO][mM]|[oO][rR][gG]|[nN][eE][tT]|[iIİı][oO]|[eE][dD][uU])"

# Suffix rules for unseen words and the names of tags they suggest, in order of preference.
SUFFIX_RULES = (
    ("ing", ("VBG", "VERB")), ("ed", ("VBD", "VERB")), ("tion", ("NN", "NOUN")), ("ment", ("NN", "NOUN")), ("ness", ("NN", "NOUN")),
    ("ship", ("NN", "NOUN")), ("ity", ("NN", "NOUN")), ("ism", ("NN", "NOUN")), ("ist", ("NN", "NOUN")), ("ous", ("JJ", "ADJ")),
    ("ive", ("JJ", "ADJ")), ("able", ("JJ", "ADJ")), ("ible", ("JJ", "ADJ")), ("ful", ("JJ", "ADJ")), ("less", ("JJ", "ADJ")),
    ("ly", ("RB", "ADV")), ("er", ("NN", "NOUN")), ("or", ("NN", "NOUN")), ("s", ("NNS", "NOUN")),
)
DEVANAGARI_RULES = (
    ("ियों", ("NN", "NOUN")), ("यों", ("NN", "NOUN")), ("ेंगे", ("VFM", "VERB")), ("ंगे", ("VFM", "VERB")), ("ओं", ("NN", "NOUN")),
    ("ों", ("NN", "NOUN")), ("ने", ("VNN", "VERB")), ("कर", ("VRB", "VERB")), ("ीय", ("JJ", "ADJ")),
)
PUNCT_TAGS = (".", "PUNCT", "PUNC", "SYM", "RD_PUNC")
NUM_TAGS = ("CD", "NUM", "QC", "QFNUM")
PROPER_TAGS = ("NNP", "PROPN", "NNPS", "NOUN")


def by_length(rules):
    """Longest suffix first; ties keep the table's order."""
    return sorted(rules, key=lambda r: -len(r[0]))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_nfc(df: DataFrame, col: str) -> DataFrame:
    """Unicode NFC of a column. Text below U+0300 is NFC already, so only other rows visit Python."""
    odd = F.coalesce(F.col(col).rlike(r"[^\x00-\x{02ff}]"), F.lit(False))
    return df.where(~odd).unionByName(df.where(odd).withColumn(col, _nfc(F.col(col))))


def _where(c: Column, has, change) -> Column:
    """change(c) where has(c), else c, which is computed once; has must hold for whatever the change would alter."""
    return F.get(F.transform(F.array(c), lambda x: F.when(has(x), change(x)).otherwise(x)), 0)


def strip_emails(c: Column) -> Column:
    return _where(c, lambda x: F.contains(x, F.lit("@")), lambda x: F.regexp_replace(x, "(?U)" + EMAIL, " "))


def strip_urls(c: Column) -> Column:
    return _where(c, lambda x: x.rlike(URL_PART), lambda x: F.regexp_replace(x, "(?iU)" + URL, " "))


def clean_text(c: Column) -> Column:
    """Control characters, e-mail addresses, URLs, curly quotes and dashes, and runs of white space, in this order."""
    c = strip_urls(strip_emails(F.regexp_replace(c, CONTROL, " ")))
    c = _where(c, lambda x: x.rlike(f"[{CURLY}]"), lambda x: F.translate(x, CURLY, STRAIGHT))
    return F.trim(F.regexp_replace(c, FAST_SPACE, " "))


def split_sentences(c: Column) -> Column:
    """Pieces of cleaned text after each sentence end."""
    pieces = F.split(F.regexp_replace(c, SENTENCE_END, "$1\n"), "\n")
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def tokenize(c: Column) -> Column:
    """Words with inner apostrophes and hyphens, numbers, and single marks of punctuation, contractions split first."""
    apart = lambda c, *patterns: reduce(lambda x, p: F.regexp_replace(x, "(?iU)" + p, "$1 $2"), patterns, c)
    c = _where(c, lambda x: F.contains(F.lower(x), F.lit("cannot")), lambda x: apart(x, CONTRACTIONS[0]))
    c = _where(c, lambda x: F.contains(x, F.lit("'")) | F.contains(x, F.lit("’")), lambda x: apart(x, *CONTRACTIONS[1:]))
    return F.regexp_extract_all(c, F.lit(FAST_TOKEN), F.lit(0))


def has_token(c: Column) -> Column:
    """Whether tokenize() finds any; contractions only put blanks between letters."""
    return c.rlike(FAST_TOKEN)


def contains_devanagari(c: Column) -> Column:
    return c.rlike(r"[\x{0900}-\x{097f}]")


def pad(tokens: Column, n: int, bos: str, eos: str) -> Column:
    if n < 1:
        raise ValueError("n must be 1 or more")
    return F.concat(F.array_repeat(F.lit(bos), n - 1), tokens, F.array(F.lit(eos)))


def _tags(names) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def match_suffix(word: Column, rules=SUFFIX_RULES) -> Column:
    """The first of the longest suffixes that leaves two characters of stem; null if none."""
    out = None
    for suffix, _ in by_length(rules):
        hit = F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + 2)
        out = F.when(hit, F.lit(suffix)) if out is None else out.when(hit, F.lit(suffix))
    return out


def _suffix_tags(word: Column, rules) -> Column:
    out = None
    for suffix, names in by_length(rules):
        hit = F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + 2)
        out = F.when(hit, _tags(names)) if out is None else out.when(hit, _tags(names))
    return out.otherwise(_tags(()))


def candidate_tags(word: Column, is_first: Column) -> Column:
    """Names of tags that a word's shape and suffix suggest; empty if nothing does."""
    return (
        F.when(word == "", _tags(()))
        .when(~word.rlike(r"[\p{L}\p{N}]"), _tags(PUNCT_TAGS))
        .when(word.rlike(r"\p{Nd}"), _tags(NUM_TAGS))
        .when(contains_devanagari(word), _suffix_tags(word, DEVANAGARI_RULES))
        .when(~is_first & word.rlike(r"^\p{Lu}"), _tags(PROPER_TAGS))
        .otherwise(_suffix_tags(F.lower(word), SUFFIX_RULES))
    )


def split_buffer(buffer: Column, order: int) -> tuple[Column, Column]:
    """(context tokens, prefix) of a typed buffer: trailing white space ends the word."""
    tokens = tokenize(F.trim(buffer))
    open_word = ~buffer.rlike(r"(?U)\s$") & (F.length(buffer) > 0)
    prefix = F.when(open_word & (F.size(tokens) > 0), F.element_at(tokens, -1)).otherwise(F.lit(""))
    context = F.when(open_word & (F.size(tokens) > 0), F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)
    keep = order - 1
    tail = F.slice(context, F.greatest(F.size(context) - keep + 1, F.lit(1)), F.lit(keep)) if keep else F.array().cast("array<string>")
    return tail, prefix

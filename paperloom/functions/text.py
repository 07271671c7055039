"""Text functions: normalising, tokens, quality, hashes, excerpts. Native expressions, but for :func:`nfc` and :func:`token_coverage`."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from paperloom.functions.vectors import once

# Fixed values.
WS = "[\t\n\x0b\f\r    -     　﻿]"
STOP_WORDS = ["cho", "trong", "the", "and", "for", "with"]
SHARD_STOP_WORDS = [*STOP_WORDS, "from", "that", "this"]
QUALITY_WEIGHTS = (0.55, 0.25, 0.2)
USEFUL_QUALITY, USEFUL_TOKENS = 0.68, 5
# End of fixed values.


@functools.cache
def _folds() -> tuple[str, str]:
    """Precomposed letters and the base letters that their decomposition starts with."""
    pairs = []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        kept = "".join(x for x in base if not 0x300 <= ord(x) <= 0x36F)
        if len(kept) == 1 and kept != c:
            pairs.append((c, kept))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@functools.cache
def _spaces() -> str:
    return "".join(chr(c) for c in range(0x10000) if re.match(WS, chr(c)))


def normalize_search_text(text: Column) -> Column:
    """Lower case, straight quotes, single spaces, trimmed. Input is taken to be NFC.

    White space becomes spaces along with the quotes, so the pattern meets runs of them alone.
    """
    straight = F.translate(F.lower(text), "\u2018\u2019\u201c\u201d" + _spaces(), "''\"\"" + " " * len(_spaces()))
    return F.trim(F.regexp_replace(straight, " {2,}", " "))


def fold_accents(text: Column) -> Column:
    """Letters without their accents; letters that don't decompose stay."""
    return F.regexp_replace(F.translate(text, *_folds()), "[̀-ͯ]", "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed letters; Spark has no expression for that."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def search_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Folded words of two characters or more that aren't stop words, in order."""
    return tokens_of_normal(F.lower(text), stop)


def tokens_of_normal(normal: Column, stop: list[str] | None = None) -> Column:
    """:func:`search_tokens` of a text that is normalised, or in lower case, already. Texts are folded whole, and only those with a letter
    beyond ASCII: no accent is taken for a letter or the end of a word, and quotes and white space end words as they are."""
    plain = F.when(F.octet_length(normal) > F.length(normal), fold_accents(normal)).otherwise(normal)
    words = F.split(plain, r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS if stop is None else stop))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(text, 256))


def normalize_hex(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "(?i)^0x", ""))


def text_quality(text: Column) -> Column:
    """0 to 1: share of readable characters, diversity of words, and length."""
    spaced = F.regexp_replace(F.regexp_replace(text, rf"https?://[^{WS[1:-1]}]+", " "), r"\p{Cc}+", " ")
    cleaned = F.trim(F.regexp_replace(spaced, f"{WS}+", " "))
    parts = lambda c: F.struct(
        F.length(c).alias("n"),
        F.regexp_count(c, F.lit(r"[\p{L}\p{N}.,;:!?()'\"-]")).alias("readable"),
        F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1)).alias("words"),
    )
    a, b, c = QUALITY_WEIGHTS

    def score(p: Column) -> Column:
        diversity = F.least(F.lit(1.0), F.size(F.array_distinct(p["words"])) / F.greatest(F.lit(8.0), F.size(p["words"]) * F.lit(0.35)))
        return F.when(p["n"] < 24, 0.0).otherwise(p["readable"] / p["n"] * a + diversity * b + F.least(F.lit(1.0), p["n"] / 120.0) * c)

    return once(once(cleaned, parts), score)


def is_useful(text: Column, quality: Column | None = None) -> Column:
    """Whether a text has words and quality enough; ``quality`` is its :func:`text_quality` where that is at hand."""
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{2,}"))
    return (words >= USEFUL_TOKENS) & ((text_quality(text) if quality is None else quality) >= USEFUL_QUALITY)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def excerpt_around(text: Column, needle: Column) -> Column:
    """The text from 140 characters before the needle (the start where absent), at least 420 long."""
    flat = collapse(text)
    at = F.instr(normalize_search_text(flat), normalize_search_text(needle))
    start = F.greatest(F.lit(0), at - 1 - 140)
    return F.trim(F.substring(flat, start + 1, F.greatest(F.length(needle) + 280, F.lit(420))))


@F.pandas_udf(LongType())
def _hits(query: pd.Series, tokens: pd.Series) -> pd.Series:
    """How many of the query's tokens are among the others: a set per row, where an array would be walked for each token."""
    held = [0 if q is None or t is None else sum(map(set(t).__contains__, q)) for q, t in zip(query, tokens)]
    return pd.Series(held, dtype="int64")


def token_coverage(query: Column, tokens: Column) -> Column:
    """Share of query tokens, duplicates counted, that occur in ``tokens``."""
    return F.when(F.size(query) > 0, _hits(query, tokens) / F.size(query)).otherwise(0.0)


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(0.0)


def longest_quote(text: Column) -> Column:
    """The longest run of eight characters or more between quotes of any style, the first among equals; null if none."""
    q = "\"'\u201c\u201d\u2018\u2019"
    runs = F.regexp_extract_all(text, F.lit(f"[{q}]([^{q}]{{8,}})[{q}]"), F.lit(1))
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    return F.trim(F.get(F.filter(runs, lambda r: F.length(r) == longest), F.lit(0)))

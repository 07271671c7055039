"""Token counts of whole texts by a two-tier lookup of pre-tokens within the map tasks.

A pre-token never shares a token with its neighbours, so a text has as many tokens
as its pre-tokens together. Tier one is a hash table of the corpus's most frequent
pre-tokens and their lengths in tokens, ``ENTRIES`` at most, which is broadcast (under
2 MB). Tier two is a cache of each Python worker: a pre-token that the table lacks
is encoded once by the library's model and remembered; where ``CACHE_ENTRIES`` would be
exceeded, the cache is begun anew with those of the present texts. No pre-token of a text is shuffled.

The table comes from a pass over all texts: every task keeps a summary of its own
most frequent pre-tokens (``SUMMARY`` at most, lossy), and only the summaries are added
up. The table decides how fast a text is counted, never its count.

Texts are normalised and split as the vocabulary's file says; strings of its special
tokens are one token each, as the library does by default. Texts with code points
that this Python's Unicode tables don't know go to the library whole.

Defined results: null text counts as empty and has no bytes and no tokens; null and
repeated ids are counted row by row; long texts are counted in pieces cut before white space;
an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm.byte_level import written
from paperloom.llm.token_store import slices

#: Pre-tokens in the broadcast table, at most, and in the summary of a task.
ENTRIES, SUMMARY = 1 << 16, 1 << 14
#: Pre-tokens that a worker remembers, at most; longer ones than ``LONGEST`` letters aren't remembered.
CACHE_ENTRIES, LONGEST = 200_000, 64
#: Longer texts are counted in pieces of about this many characters.
PIECE = 1 << 20

_SPACE = regex.compile(r"\s")
_counters: dict[str, "Counters"] = {}


class Counters:
    """A vocabulary's pre-tokens and their lengths; its file must lower-case, split by a pattern and write bytes as letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in form["added_tokens"]))
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many tokens it has besides theirs."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [], len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        found: list[str] = []
        parts = self.special.split(text) if "<|" in text else [text]
        for part in parts:
            # letter by letter, so without a final sigma
            part = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            found += self.pattern.findall(part)
        return found, len(parts) - 1

    def length(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(written(pre_token)))

    def lengths(self, pre_tokens: list[str], frequent: dict[str, int]) -> np.ndarray:
        """How many tokens each pre-token has: from the table, else from the cache, else from the library."""
        out = np.fromiter(map(frequent.get, pre_tokens, repeat(0)), np.int64, len(pre_tokens))
        missed = np.flatnonzero(out == 0)
        names = [pre_tokens[i] for i in missed.tolist()]
        new = {p: self.length(p) for p in set(names) if p not in self.cache}
        out[missed] = [new.get(p) or self.cache[p] for p in names]
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache = {}
        self.cache.update((p, n) for p, n in new.items() if len(p) <= LONGEST)
        return out

    def count(self, texts: list[str], frequent: dict[str, int]) -> np.ndarray:
        """How many tokens each text has."""
        pre_tokens: list[str] = []
        ends, more = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                for part in pieces(text):
                    found, others = self.split(part)
                    more[i] += others + int(self.lengths(found, frequent).sum())
            else:
                found, more[i] = self.split(text)
                pre_tokens += found
            ends[i] = len(pre_tokens)
        totals = np.r_[0, np.cumsum(self.lengths(pre_tokens, frequent))]
        return np.diff(totals[np.r_[0, ends]]) + more


def pieces(text: str) -> Iterator[str]:
    """A text cut before white space, after about ``PIECE`` characters each."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + PIECE)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def counters(path: str) -> Counters:
    """This worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counters(path)
    return _counters[path]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for a, b in slices(batch, "text"):
            part = batch.slice(a, b - a)
            yield part, part.column("text").to_pylist()


def summaries(docs: DataFrame, vocabulary: str, text: str = "text", summary: int = SUMMARY) -> DataFrame:
    """``pre_token, c``: of each task's texts the pre-tokens that are most frequent there, and about how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = counters(vocabulary), Counter()
        for _, texts in _texts(batches):
            for whole in texts:
                for part in pieces(whole) if len(whole) > PIECE else [whole]:
                    held.update(counter.split(part)[0])
            if len(held) > 8 * summary:
                held = Counter(dict(held.most_common(4 * summary)))
        top = [(p, c) for p, c in held.most_common(summary) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["pre_token", "c"])

    return docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).mapInArrow(count, "pre_token string, c bigint")


def frequent_lengths(docs: DataFrame, vocabulary: str, text: str = "text", entries: int = ENTRIES) -> dict[str, int]:
    """The table of the most frequent pre-tokens: how many tokens each has."""
    summed = summaries(docs, vocabulary, text).groupBy("pre_token").agg(F.sum("c").alias("c"))
    top = summed.orderBy(F.desc("c"), "pre_token").limit(entries).select("pre_token").toArrow()  # bounded by entries
    counter = counters(vocabulary)
    return {p: counter.length(p) for p in top.column("pre_token").to_pylist()}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, text: str = "text", doc_id: str = "doc_id", table: Broadcast | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text; ``table`` may hold the frequent pre-tokens of an earlier run."""
    shared = table or docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, frequent = counters(vocabulary), shared.value
        for part, texts in _texts(batches):
            n = counter.count(texts, frequent)
            size = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")

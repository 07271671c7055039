"""Periodic runs of words, by an online sparse dynamic programme over diagonals.

A run is a stretch of words with smallest period q, at least ``least`` words and
``times`` periods long, that no neighbouring word extends. On the diagonal of lag q
its words equal those q places before, so the match length there grows by one a word,
and the run is emitted where that growth ends.

A diagonal counts a match of *every* earlier occurrence of a word; done literally that
is quadratic in a text's frequent words. The programme is sparse instead: lags are
taken in classes (k/2, k] for k = 1, 2, 4, ..., and in the class of k the earlier
occurrences of a word are those that end the same k words. Of these only the latest
can be the lag of a run: with an earlier one at a distance d < q too, k >= q words would have both
periods, so the run's smallest period would be under q. A run of lag q holds at least
``(times - 1) * q`` >= k matches, so its diagonal is met in its class. So every word has at most
one active lag in each class, a text of n words costs O(n log n) however often a word
occurs, and a class looks only at those words whose last k/2 words occur twice in
their text (in prose few are left from k = 4 on).

Texts are handled in groups of some millions of characters; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; null and repeated ids
are handled row by row; texts are read whole; an empty table gives an empty one; other columns are
ignored, whatever their names. Ties of the longest run go to the smallest start, then period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.token_store import slices

_NONE = np.zeros(0, np.int64)


class Runs(NamedTuple):
    """Runs ordered by start, then period; places are counted in the symbols they were found in."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def latest(symbols: np.ndarray) -> np.ndarray:
    """For each place the latest earlier place with the same symbol, or -1."""
    order = np.argsort(symbols, kind="stable")
    before = np.full(len(symbols), -1)
    same = symbols[order[1:]] == symbols[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def emitted(place: np.ndarray, lag: np.ndarray, k: int, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Start, length and period of the runs of one class: ``lag`` is active at ``place``, where k matches have been counted when it begins."""
    if not len(place):
        return _NONE, _NONE, _NONE
    begins = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(lag) != 0)])
    grown = np.diff(np.r_[begins, len(place)])  # words for which the diagonal stayed active
    period = lag[begins]
    length = k - 1 + grown + period
    ok = length >= np.maximum(least, times * period)
    return (place[begins] - k + 1 - period)[ok], length[ok], period[ok]


def find_runs(words: np.ndarray, least: int = 6, times: int = 4) -> Runs:
    """The runs of a sequence of words given as numbers. Texts may follow one another if none shares a number with another."""
    if times < 3:
        raise ValueError("a run must hold three periods, so that its diagonal holds k matches")
    parts = [(_NONE, _NONE, _NONE)]
    place, k = np.arange(len(words)), 1
    code = np.unique(words, return_inverse=True)[1] if len(words) else _NONE
    ids = np.full(len(words), -1)  # which of the repeated stretches of k words ends at a place
    while len(place):
        recurs = np.bincount(code)[code] > 1
        place, code = place[recurs], code[recurs]
        if not len(place):
            break
        before = latest(code)
        lag = np.where(before >= 0, place - place[before], 0)
        active = (lag > k // 2) & (lag <= k)
        parts.append(emitted(place[active], lag[active], k, least, times))
        ids[:] = -1
        ids[place] = code
        place = place[place >= k]
        place = place[ids[place - k] >= 0]
        code = np.unique(ids[place - k] * (int(ids.max()) + 1) + ids[place], return_inverse=True)[1]
        k *= 2
    start, length, period = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def repeated(n: int, runs: Runs) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:n]) > 0


_EMPTY = hashlib.sha256(b"").hexdigest()

COLUMNS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
SPANS = "doc_id bigint, start bigint, length bigint, period bigint"

#: Takes an id and a number of words: the places in the text of the words to look at, or None for all as they are.
Places = Callable[[int | None, int], np.ndarray | None]


def _groups(batches: Iterator[pa.RecordBatch], places: Places | None) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray, Runs]]:
    """For groups of texts: their rows, all words, where each text ends among them, which text each word is of, and the runs."""
    for batch in batches:
        for a, b in slices(batch, "body"):
            part = batch.slice(a, b - a)
            words: list[bytes] = []
            ends = np.zeros(part.num_rows + 1, np.int64)
            for i, (doc_id, body) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist())):
                own = body.split()  # at bytes 0x09-0x0D and 0x20
                at = places(doc_id, len(own)) if places else None
                words += own if at is None else [own[j] for j in at.tolist()]
                ends[i + 1] = len(words)
            owner = np.repeat(np.arange(part.num_rows), np.diff(ends))
            coded = pa.array(words, pa.large_binary()).dictionary_encode()
            symbols = coded.indices.to_numpy().astype(np.int64) + owner * len(coded.dictionary)
            yield part, words, ends, owner, find_runs(symbols)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("body"))


def run_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each run: its document, first word (from 0), words and period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ends, owner, runs in _groups(batches, None):
            doc = owner[runs.start]
            cols = [part.column("doc_id").take(pa.array(doc)), pa.array(runs.start - ends[doc]), pa.array(runs.length), pa.array(runs.period)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "period"])

    return _rows(docs, text, doc_id).mapInArrow(find, SPANS)


def collapse(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text``: the words of each text joined by a space, those of a run only once."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, ends, _, runs in _groups(batches, None):
            texts = _joined(words, ends, repeated(len(words), runs))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return _rows(docs, text, doc_id).mapInArrow(keep, "doc_id bigint, text string")


def _joined(words: list[bytes], ends: np.ndarray, dropped: np.ndarray) -> list[bytes]:
    """The words of each text that aren't dropped, joined by a space."""
    some = np.add.reduceat(np.r_[dropped, False], ends[:-1]) * (np.diff(ends) > 0) if len(ends) > 1 else []
    out = []
    for i, lost in enumerate(some):
        own = words[ends[i] : ends[i + 1]]
        if lost:
            own = [own[j] for j in np.flatnonzero(~dropped[ends[i] : ends[i + 1]]).tolist()]
        out.append(b" ".join(own))
    return out


def digest_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", places: Places | None = None) -> DataFrame:
    """``doc_id`` and :data:`COLUMNS`: how many runs, the longest, and digests of all runs and of the text without repeats."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, ends, owner, runs in _groups(batches, places):
            doc = owner[runs.start]
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))  # runs are ordered by start, so by text
            best: list[tuple | None] = [None] * part.num_rows
            lines = [_EMPTY] * part.num_rows
            for i in np.unique(doc).tolist():
                a, b = bounds[i], bounds[i + 1]
                own = list(zip((runs.start[a:b] - ends[i]).tolist(), runs.length[a:b].tolist(), runs.period[a:b].tolist()))
                best[i] = min(own, key=lambda r: (-r[1], r[0], r[2]))
                lines[i] = hashlib.sha256("".join("%d,%d,%d\n" % r for r in own).encode()).hexdigest()
            kept = [hashlib.sha256(t).hexdigest() for t in _joined(words, ends, repeated(len(words), runs))]
            longest = [pa.array([r and r[j] for r in best], pa.int64()) for j in range(3)]
            exponent = pa.array([r and 1000 * r[1] // r[2] for r in best], pa.int64())
            cols = [part.column("doc_id"), pa.array(np.diff(bounds)), *longest, exponent, pa.array(lines), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]])

    return _rows(docs, text, doc_id).mapInArrow(digest, f"doc_id bigint, {COLUMNS}")

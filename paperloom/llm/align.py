"""Which tokens of two tokenizers cover the same bytes, and which pairs of ids go together over a corpus.

Both tokenizers' tokens cut a text at byte offsets. Texts are aligned by divide and
conquer: in an interval of tokens a common cut near its middle is located by
bisecting the second tokenizer's cuts for those of the first around the middle, a
window of which is doubled until it holds one; the interval is split there and both halves are
treated alike; an interval without a common cut is a leaf, a group. All intervals of
a group of texts are treated together, a level of the recursion at a time, by numpy.

A link is a pair of tokens that end together, so there is one to a group. Links are
counted over the corpus by their pair of ids: within the tasks, then by Spark. Counts
reach the links by a table of the ``FREQUENT`` most frequent pairs, which is broadcast (16
bytes a pair), and by a join for the links of rarer pairs, summed within a text before.
The highest count of each id of the second vocabulary is one row per id.

Defined results: null and empty texts, and those whose tokens' bytes differ from the space and the text, have
no tokens, zeros and an empty digest; null and repeated ids are handled row by row; texts are read whole;
ties for the highest count all count as best; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from paperloom.llm import byte_level
from paperloom.llm.common import materialize, small_batches
from paperloom.llm.token_store import slices
from paperloom.llm.tokens import _Ids, encoder

#: Pairs in the broadcast table, at most: 16 MB.
FREQUENT = 1 << 20
#: Texts are aligned in groups of about this many characters, and stretches remembered in so many bytes.
GROUP_CHARS, PIECE_MEMO = 1_000_000, 24 << 20
#: Rows that Spark gives a Python worker at a time.
BATCH_ROWS = 1000
#: Links that are looked up at a time.
LOOKED_UP = 500_000
#: Steps of a doubling of the count by which the least count of a frequent pair is chosen.
STEPS = 8

_UNITS = re.compile(r" *[^ \n]+| +|\n")


class PieceEncoder:
    """Ids of whole texts by a sentencepiece model that keeps its input as it is, puts a space before it and falls back to bytes.

    No piece holds a space after another character, or a line end, so no token crosses a cut before a
    space that a non-space precedes or beside a line end. The stretches between are encoded once and remembered.
    """

    def __init__(self, path: str, memo_bytes: int = PIECE_MEMO):
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in n.lstrip("▁") or "\n" in n for n in names):
            raise ValueError("the vocabulary has tokens across words or lines")
        self.bytes = np.array([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)], object)
        self.memo_bytes = memo_bytes
        self.forget()

    def forget(self) -> None:
        self.ids, self.held = _Ids(), 0
        self.memo: dict[str, int] = {}
        # a lone space isn't an input of the library's: it takes an empty text for no text
        self._keep([" "], [[self.model.piece_to_id("▁")]])

    def _keep(self, units: list[str], found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.memo.update(zip(units, self.ids.add(np.array([i for f in found for i in f], np.uint32), sizes)))
        self.held += sum(map(len, units)) + 200 * len(units) + 4 * int(sizes.sum())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each of which begins with the space that the library would add, and where each ends.

        Words after single spaces are found by Arrow and each is looked up once; texts with other spaces are cut by a pattern.
        """
        if self.held > self.memo_bytes:
            self.forget()
        lists = pc.split_pattern(pa.array([t[1:] for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words, of_word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        cuts = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        uneven = np.add.reduceat(of_word == words.index(""), cuts[:-1]) > 0 if "" in words else np.zeros(len(texts), bool)
        numbers = self._numbers([" " + w for w in words])[of_word]
        if not uneven.any():
            flat, at = self.ids.gather(numbers)
            return flat, np.r_[0, at][cuts[1:]]
        parts = [numbers[cuts[i] : cuts[i + 1]] if not odd else self._numbers(_UNITS.findall(texts[i])) for i, odd in enumerate(uneven)]
        flat, at = self.ids.gather(np.concatenate(parts))
        return flat, np.r_[0, at][np.cumsum([len(p) for p in parts])]

    def _numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of the units' lists of ids; new units are encoded."""
        numbers = np.fromiter(map(self.memo.get, units, repeat(0)), np.int64, len(units))
        missed = np.flatnonzero(numbers == 0)
        if len(missed):
            names = [units[i] for i in missed.tolist()]
            new = list(dict.fromkeys(names))
            spaced, bare = [u for u in new if u[0] == " "], [u for u in new if u[0] != " "]
            self._keep(spaced, self.model.encode([u[1:] for u in spaced]))
            # a line end before keeps the library's own space away: two tokens, taken off again
            self._keep(bare, [f[2:] for f in self.model.encode(["\n" + u for u in bare])])
            numbers[missed] = [self.memo[u] for u in names]
        return numbers


class _Vocabularies:
    def __init__(self, a: str, b: str):
        with open(a, encoding="utf-8") as f:
            form = json.load(f)
        names = form["model"]["vocab"] | {t["content"]: t["id"] for t in form["added_tokens"]}
        self.a_bytes = np.array([byte_level.read(n) for n in sorted(names, key=names.get)], object)
        self.b = PieceEncoder(b)
        self.b_bytes = self.b.bytes
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        decimals = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.text = {end: np.array([d + end for d in decimals], object) for end in ",|;"}


_vocabularies: dict[tuple[str, str], _Vocabularies] = {}


def vocabularies(a: str, b: str) -> _Vocabularies:
    """This worker's tables for two vocabulary files."""
    if (a, b) not in _vocabularies:
        _vocabularies[a, b] = _Vocabularies(a, b)
    return _vocabularies[a, b]


def common_cuts(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places in ``a`` of its values that ``b`` holds too (both ascend), within intervals ``low <= place < high`` of ``a``.

    Divide and conquer: each interval is cut at the common value nearest to its middle, then both halves are treated alike.
    """
    common = np.zeros(len(a), bool)
    while len(low):  # intervals in order, so that bisection goes forward through ``b``
        middle, cut = (low + high - 1) // 2, np.full(len(low), -1)
        todo, done, reach = np.arange(len(low)), 0, 1
        while len(todo):
            # places done to reach - 1 right and left of each middle, nearest first
            step = np.stack([np.arange(done, reach), -np.arange(done, reach)], 1).ravel()[not done :]
            at = middle[todo, None] + step
            inside = (at >= low[todo, None]) & (at < high[todo, None])
            value = a[np.where(inside, at, middle[todo, None])]
            hit = inside & (b[np.minimum(np.searchsorted(b, value), len(b) - 1)] == value)
            got, first = hit.any(1), hit.argmax(1)
            cut[todo[got]] = at[np.flatnonzero(got), first[got]]
            todo = todo[~got]
            todo = todo[(middle[todo] + reach < high[todo]) | (middle[todo] - reach >= low[todo])]
            done, reach = reach, 2 * reach
        low, high, cut = (x[cut >= 0] for x in (low, high, cut))
        common[cut] = True
        low, high = np.stack([low, cut + 1], 1).ravel(), np.stack([cut, high], 1).ravel()
        low, high = low[low < high], high[low < high]
    return np.flatnonzero(common)


class Aligned(NamedTuple):
    """Texts whose tokens were aligned: ids and where each text's end, and the last tokens of the groups."""

    a: np.ndarray
    a_ends: np.ndarray  # from 0
    b: np.ndarray
    b_ends: np.ndarray
    a_last: np.ndarray  # places in ``a``, one to a group
    b_last: np.ndarray


def _same(bytes_of: np.ndarray, ids: np.ndarray, ends: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts' tokens hold the text's bytes; most often all do, which one comparison tells if their sizes are right."""
    parts = bytes_of[ids].tolist()
    sizes = np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))][ends]
    if np.array_equal(np.diff(sizes), np.fromiter(map(len, texts), np.int64, len(texts))) and b"".join(parts) == b"".join(texts):
        return np.ones(len(texts), bool)
    return np.array([b"".join(parts[x:y]) == t for x, y, t in zip(ends, ends[1:], texts)], bool)


def align_texts(texts: list[str], a: str, b: str, coder) -> Aligned:
    """Encode each text (a space is put before those that aren't empty) by both vocabularies and align them; ``coder`` is that of ``a``."""
    both = vocabularies(a, b)
    spaced = [" " + t if t else "" for t in texts]
    (a_ids, a_ends), (b_ids, b_ends) = coder.encode(spaced), both.b.encode(spaced)
    a_ids, b_ids = a_ids.astype(np.int64), b_ids.astype(np.int64)
    a_ends, b_ends = np.r_[0, a_ends].astype(np.int64), np.r_[0, b_ends].astype(np.int64)
    raw = [t.encode() for t in spaced]
    good = _same(both.a_bytes, a_ids, a_ends, raw) & _same(both.b_bytes, b_ids, b_ends, raw)
    if not good.all():
        a_ids, b_ids = a_ids[np.repeat(good, np.diff(a_ends))], b_ids[np.repeat(good, np.diff(b_ends))]
        a_ends, b_ends = (np.r_[0, np.cumsum(np.where(good, np.diff(x), 0))] for x in (a_ends, b_ends))
    a_cuts, b_cuts = np.cumsum(both.a_sizes[a_ids]), np.cumsum(both.b_sizes[b_ids])
    used = np.flatnonzero(np.diff(a_ends))
    a_last = common_cuts(a_cuts, b_cuts, a_ends[used], a_ends[used + 1])
    return Aligned(a_ids, a_ends, b_ids, b_ends, a_last, np.searchsorted(b_cuts, a_cuts[a_last]))


def written_groups(found: Aligned, a: str, b: str) -> list[str]:
    """The groups of each text, as ``a1,a2|b1;a3|b2,b3``."""
    text = vocabularies(a, b).text
    a_place, b_place = np.arange(len(found.a)), np.arange(len(found.b))
    a_group, b_group = np.searchsorted(found.a_last, a_place), np.searchsorted(found.b_last, b_place)
    out = np.empty(len(found.a) + len(found.b), object)
    # before a token stand all of its own side up to it, and of the other side those of the groups before (for b: and of its own)
    for ids, place, group, last, others, mark in (
        (found.a, a_place, a_group, found.a_last, np.r_[0, found.b_last + 1], "|"),
        (found.b, b_place, b_group, found.b_last, found.a_last + 1, ";"),
    ):
        words = text[","][ids]
        words[last] = text[mark][ids[last]]
        out[place + others[group]] = words
    parts, ends = out.tolist(), found.a_ends + found.b_ends
    return ["".join(parts[x:y])[:-1] for x, y in zip(ends, ends[1:])]


ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, a array<int>, b array<int>, groups_sha256 string"


def align(docs: DataFrame, a: str, b: str, text: str = "text", doc_id: str = "doc_id", spaced: bool = True) -> DataFrame:
    """For every text: ``row`` (a number of its own), how many tokens each vocabulary gives, the ids of its links, one
    to a group, and the digest of its groups."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        with encoder(a, spaced) as coder:
            for batch in batches:
                for x, y in slices(batch, "text", GROUP_CHARS):
                    part = batch.slice(x, y - x)
                    found = align_texts(part.column("text").to_pylist(), a, b, coder)
                    groups = written_groups(found, a, b)
                    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                    bounds = pa.array(np.searchsorted(found.a_last, found.a_ends).astype(np.int32))
                    links = [pa.ListArray.from_arrays(bounds, pa.array(ids[last].astype(np.int32))) for ids, last in ((found.a, found.a_last), (found.b, found.b_last))]
                    n = [pa.array(np.diff(ends)) for ends in (found.a_ends, found.b_ends)]
                    cols = [pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"), *n, *links, pa.array(digests)]
                    yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in ALIGNED.split(", ")])
                    row += part.num_rows
        vocabularies(a, b).b.forget()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(find, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, c, best``: how many links hold each pair of ids, and whether no other pair of that b has more."""
    counted = aligned.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("c"))
    counted = materialize(counted, "pairs")
    most = counted.groupBy("b").agg(F.max("c").alias("most"))  # a row for each id of the vocabulary at most
    return counted.join(F.broadcast(most), "b").select("a", "b", "c", (F.col("c") == F.col("most")).alias("best"))


def _least_count(pairs: DataFrame, frequent: int) -> tuple[float, bool]:
    """The least step of counts from which on there are ``frequent`` pairs at most, and whether some pairs lie below."""
    steps = pairs.groupBy(F.floor(F.log2("c") * STEPS).alias("step")).count().orderBy(F.desc("step")).collect()  # 64 * STEPS rows at most
    least, held = float("inf"), 0
    for step, n in steps:
        if held + n > frequent:
            return least, True
        least, held = step, held + n
    return least, False


def link_counts(docs: DataFrame, a: str, b: str, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every text."""
    spark = docs.sparkSession
    with small_batches(spark, BATCH_ROWS):
        aligned = materialize(align(docs, a, b, text, doc_id), "aligned")
    pairs = pair_counts(aligned)
    step = F.floor(F.log2("c") * STEPS)
    least, rest = _least_count(pairs, frequent)
    table = pairs.filter(step >= F.lit(least)).select((F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("code"), "c", "best").toArrow()  # bounded by ``frequent``
    code, c, best = (table.column(i).to_numpy() for i in range(3))
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order], c[order], best[order].astype(np.int64)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("a").offsets.to_numpy().astype(np.int64) // LOOKED_UP
            cuts = np.r_[0, 1 + np.flatnonzero(np.diff(held[:-1])), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x < y:
                    yield looked_up(batch.slice(x, y - x))

    def looked_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, c, best = shared.value
        ends = batch.column("a").offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        own_a, own_b = (batch.column(x).flatten().to_numpy() for x in ("a", "b"))
        distinct, at = np.unique((own_a.astype(np.int64) << 32) + own_b, return_inverse=True)
        place = np.minimum(np.searchsorted(code, distinct), max(len(code) - 1, 0))
        known = code[place] == distinct if len(code) else np.zeros(len(distinct), bool)
        sums = [np.r_[0, np.cumsum(np.where(known, x[place] if len(code) else 0, 0)[at])] for x in (best, c)]
        totals = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
        rare = ~known[at]
        bounds = pa.array(np.r_[0, np.cumsum(rare)][ends].astype(np.int32))
        left = [pa.ListArray.from_arrays(bounds, pa.array(x[rare])) for x in (own_a, own_b)]
        n = pa.array(np.diff(ends))
        cols = [*(batch.column(x) for x in ("row", "doc_id", "n_a", "n_b")), n, n, *totals, batch.column("groups_sha256"), *left]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in told.split(", ")])

    told = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, a array<int>, b array<int>"
    with small_batches(spark, BATCH_ROWS):
        found = materialize(aligned.mapInArrow(look_up, told), "looked-up")
    if not rest:
        return found.drop("row", "a", "b")
    rare = found.select("row", F.inline(F.arrays_zip("a", "b"))).groupBy("row", "a", "b").agg(F.count("*").alias("n"))
    rare = rare.join(pairs.filter(step < F.lit(least)), ["a", "b"])
    more = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("c")).alias("more_count"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"))
    total = {x: (F.col(x) + F.coalesce(F.col(y), F.lit(0))) for x, y in (("n_best", "more_best"), ("count_sum", "more_count"))}
    return found.join(more, "row", "left").withColumns(total).drop("row", "a", "b", "more_count", "more_best")

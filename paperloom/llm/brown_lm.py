"""Language-model scoring by a Brown class-based bigram model.

``P(w | v) = P(class(w) | class(v)) * P(w | class(w))``. All words of all training
documents are counted, and every one gets its own class:

* The ``CORE`` most frequent words are clustered by exact exchange: each word in turn
  moves to the class that raises the likelihood most, with all counts kept up to
  date. This is the only part on the driver, on ``CORE`` x ``CORE`` counts at most.
* Words of at least ``exchange_share`` of the tokens (``1 / exchange_share`` at
  most, at any size of corpus) join the classes that fit them best, and all of them
  are exchanged further in batches: Spark sums every word's neighbours by class over
  all bigrams, moves are scored against these fixed counts, and a batch stays only
  if the likelihood of the recounted classes has risen; else its better half is tried.
* Every rarer word gets the class that fits its own neighbours best. These are summed
  by word in Spark, and the choice is made in the tasks against the class bigrams.

Words from ``lookup_share`` of the tokens on are broadcast with their classes
(``1 / lookup_share`` at most). All others reach their documents by a join on the
word, once a document, so no word of a third of the corpus is ever a join key.

Defined results: null text counts as empty, which has the end token alone; a null
id is hashed as the empty string; repeated rows get one row each; very long texts
are read whole, a row at a time; words with equal counts rank by their bytes, of
equally good classes the first is taken; with no training documents all tokens are
unknown; an empty table gives an empty result; other columns are ignored whatever
their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, shuffle_partitions

#: White space is never a word, so this stands for the end of a document.
END = b"\n"
#: Words whose exchange is exact.
CORE = 2048
#: Distinct words a task holds before it passes its counts on.
_HELD = 400_000
#: What a class bigram that never occurred counts as where a class is chosen.
_FLOOR = 0.1


@dataclass
class Model:
    """What scoring broadcasts (arrays of bounded size) and the table of all rarer words."""

    index: dict[bytes, int]  # words from lookup_share on; END is 0
    counts: np.ndarray  # of those words
    classes: np.ndarray  # of those words
    n_frequent: int  # words below this place were exchanged
    transition: np.ndarray  # log10 P(class | class before)
    sizes: np.ndarray  # tokens of each class
    unseen_class: int  # where words that training never saw belong
    unseen_words: int  # distinct words of that class
    tokens: int
    words: int
    discount: float
    rare: DataFrame | None = field(default=None, repr=False)  # word, c, cls of all words but the exchanged

    def emission(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words with these classes and counts; a count of 0 is an unseen word."""
        own = counts - np.where(classes == self.unseen_class, self.discount, 0.0)
        unseen = self.discount * self.unseen_words
        part = np.where(counts > 0, own, unseen)
        return np.where(part > 0, np.log10(np.maximum(part, 1e-9) / np.maximum(self.sizes[classes], 1e-9)), 0.0)


def _tokens(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """For slices of a batch: first row, tokens of its texts one after the other, number of tokens of each."""
    for at in range(0, batch.num_rows, rows):
        texts = batch.column("body").slice(at, rows).to_pylist()
        words, sizes = [], []
        for t in texts:
            w = t.lower().split()
            words += w
            words.append(END)
            sizes.append(len(w) + 1)
        yield at, words, np.array(sizes)


def _body(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("body")


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, c`` over all texts, the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def flush() -> pa.RecordBatch:
            cols = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["word", "c"])

        for batch in batches:
            for _, words, _ in _tokens(batch):
                held.update(words)
                if len(held) > _HELD:
                    yield flush()
        yield flush()

    counted = docs.select(_body(docs, text)).mapInArrow(count, "word binary, c bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def _places(words: list[bytes], index: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter(map(index.get, words, repeat(other)), np.int64, len(words))


def count_pairs(docs: DataFrame, frequent: Broadcast, size: int, text: str = "text") -> DataFrame:
    """``a, b, c``: how often symbol b follows symbol a, over all texts; symbol ``size - 1`` is any rarer word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            codes, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes // size), pa.array(codes % size), pa.array(c.astype(np.int64))], names=["a", "b", "c"])

        for batch in batches:
            for _, words, _ in _tokens(batch):
                s = _places(words, frequent.value, size - 1)
                held.append(np.r_[0, s[:-1]] * size + s)
                n += len(s)
                if n > 2_000_000:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    raw = docs.select(_body(docs, text)).mapInArrow(count, "a bigint, b bigint, c bigint")
    return raw.groupBy("a", "b").agg(F.sum("c").alias("c"))


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a small table of numbers, which come as Arrow batches."""
    return [c.to_numpy() for c in df.toArrow().columns]


def neighbours(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol, how many of its right and of its left neighbours are of each class (symbols x classes, bounded)."""
    spark = pairs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(enumerate(classes.tolist())), "symbol bigint, cls int"))
    told = pairs.join(table.select(F.col("symbol").alias("b"), F.col("cls").alias("cb")), "b").join(table.select(F.col("symbol").alias("a"), F.col("cls").alias("ca")), "a")
    right, left = F.col("a") * n_classes + F.col("cb"), (F.col("b") + len(classes)) * n_classes + F.col("ca")
    cells = told.select("c", F.explode(F.array(right.cast("int"), left.cast("int"))).alias("cell"))
    cell, c = _columns(cells.groupBy("cell").agg(F.sum("c").alias("c")))
    out = np.zeros(2 * len(classes) * n_classes)
    out[cell] = c
    return tuple(out.reshape(2, len(classes), n_classes))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def bigrams_of(classes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How often each class follows each."""
    out = np.zeros((right.shape[1], right.shape[1]))
    np.add.at(out, classes, right)
    return out


def likelihood(bigrams: np.ndarray) -> float:
    """The log likelihood of classes, but for what doesn't depend on them."""
    return float(_xlogx(bigrams).sum() - _xlogx(bigrams.sum(0)).sum() - _xlogx(bigrams.sum(1)).sum())


class _Classes:
    """Class bigrams and how many tokens each class has before and after it, as symbols are taken out and put in."""

    def __init__(self, classes: np.ndarray, bigrams: np.ndarray, n_right: np.ndarray, n_left: np.ndarray):
        self.bigrams, self.symbols = bigrams, (n_right, n_left)
        self.sizes = [np.bincount(classes, n, len(bigrams)) for n in self.symbols]

    def add(self, s: int, k: int, right: np.ndarray, left: np.ndarray, own: float, sign: int) -> None:
        """Count a symbol in class ``k``, or take it out (``sign`` -1); ``right`` and ``left`` leave out its ``own`` bigrams with itself."""
        self.bigrams[k] += sign * right
        self.bigrams[:, k] += sign * left
        self.bigrams[k, k] += sign * own
        for size, n in zip(self.sizes, self.symbols):
            size[k] += sign * n[s]

    def gains(self, s: int, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
        """What a symbol that is in no class adds to the likelihood in each."""
        met, inner = self.bigrams, np.diagonal(self.bigrams)
        held = _xlogx(met)
        gain = (_xlogx(met + right) - held).sum(1) + (_xlogx(met + left[:, None]) - held).sum(0)
        gain += _xlogx(inner + right + left + own) - _xlogx(inner + right) - _xlogx(inner + left) + _xlogx(inner)
        for size, n in zip(self.sizes, self.symbols):
            gain -= _xlogx(size + n[s]) - _xlogx(size)
        return gain


def exchange(classes: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n_classes: int, passes: int = 8) -> np.ndarray:
    """Exact exchange of the symbols 1, 2, ... over their bigrams ``a, b, c``, most frequent first; symbol 0 keeps class 0 to itself."""
    classes, n = classes.copy(), len(classes)
    own = np.bincount(a[a == b], c[a == b], n)
    sides = []
    for x, y in ((a, b), (b, a)):
        order = np.flatnonzero(x != y)
        order = order[np.argsort(x[order], kind="stable")].astype(np.int32)
        sides.append((np.searchsorted(x[order], np.arange(n + 1)), y[order], c[order]))
    bigrams = np.zeros((n_classes, n_classes))
    np.add.at(bigrams, (classes[a], classes[b]), c)
    state = _Classes(classes, bigrams, np.bincount(a, c, n), np.bincount(b, c, n))
    counts = sum(state.symbols)
    ranked = [s for s in np.argsort(-counts, kind="stable") if s and counts[s]]
    for _ in range(passes):
        moved = 0
        for s in ranked:
            right, left = (np.bincount(classes[other[at[s] : at[s + 1]]], weight[at[s] : at[s + 1]], n_classes) for at, other, weight in sides)
            state.add(s, classes[s], right, left, own[s], -1)
            gain = state.gains(s, right, left, own[s])
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] > gain[classes[s]] + 1e-9:
                classes[s], moved = new, moved + 1
            state.add(s, classes[s], right, left, own[s], 1)
        if not moved:
            break
    return classes


def best_moves(classes: np.ndarray, movable: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each movable symbol the best of the classes 1 to ``allowed`` - 1 while all others stay, and what the move would gain."""
    state = _Classes(classes, bigrams_of(classes, right), right.sum(1), left.sum(1))
    to, gained = classes[movable].copy(), np.zeros(len(movable))
    for i, s in enumerate(movable):
        k, r, l = classes[s], right[s].copy(), left[s].copy()
        r[k] -= own[s]
        l[k] -= own[s]
        state.add(s, k, r, l, own[s], -1)
        gain = state.gains(s, r, l, own[s])
        state.add(s, k, r, l, own[s], 1)
        stay, gain[0], gain[allowed:] = gain[k], -np.inf, -np.inf
        new = int(np.argmax(gain))
        if gain[new] > stay + 1e-9 or k >= allowed:
            to[i], gained[i] = new, gain[new] - stay
    return to, gained


def exchange_batches(classes: np.ndarray, movable: np.ndarray, own: np.ndarray, allowed: int, count: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Batched exchange: moves are scored against the neighbours that ``count(classes)`` gives, applied together, and kept only if
    the recounted likelihood has risen; else the better half of them is tried. Returns the classes, their right neighbours and the
    likelihood of each accepted state; ``count`` is called ``rounds`` times after the first at most."""
    right, left = count(classes)
    history = [likelihood(bigrams_of(classes, right))]
    while rounds > 0:
        to, gained = best_moves(classes, movable, right, left, own, allowed)
        order = np.argsort(-gained, kind="stable")[: int((gained > 0).sum())]
        accepted = False
        while len(order) and rounds > 0 and not accepted:
            tried = classes.copy()
            tried[movable[order]] = to[order]
            found, rounds = count(tried), rounds - 1
            value = likelihood(bigrams_of(tried, found[0]))
            if value > history[-1]:
                classes, (right, left), accepted = tried, found, True
                history.append(value)
            order = order[: len(order) // 2]
        if not accepted:
            break
    return classes, right, history


def _contexts(docs: DataFrame, shared: Broadcast, other: int, text: str) -> DataFrame:
    """``word, code, c`` of the words that aren't in ``shared``: how often their right neighbour (even codes) or left one (odd) is of a class; ``other`` stands for another such word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes = shared.value
        for batch in batches:
            for _, words, _ in _tokens(batch):
                place = _places(words, frequent, -1)
                cls = np.where(place < 0, other, classes[place])
                at = np.flatnonzero(place < 0)
                if len(at):
                    rare = pa.array([words[i] for i in at.tolist()], pa.binary())
                    code = np.r_[2 * cls[at + 1], 2 * np.where(at > 0, cls[at - 1], 0) + 1]  # the first word follows an end
                    table = pa.table({"word": pa.chunked_array([rare, rare]), "code": code}).group_by(["word", "code"]).aggregate([([], "count_all")])
                    yield from table.select(["word", "code", "count_all"]).rename_columns(["word", "code", "c"]).to_batches()

    return docs.select(_body(docs, text)).mapInArrow(count, "word binary, code bigint, c bigint")


def _assign(contexts: DataFrame, bigrams: np.ndarray, n_classes: int) -> DataFrame:
    """``word, c, cls, code, n`` from :func:`_contexts`: the class that fits each word's neighbours best, to the first order in its counts."""
    inner = bigrams[:n_classes, :n_classes] + _FLOOR
    to = np.log(inner / inner.sum(1, keepdims=True))  # of the class before
    by = np.log(inner.T / inner.sum(0)[:, None])  # of the class after
    fit = np.zeros((2 * n_classes + 2, n_classes))
    # a word of class k before a neighbour of class j: log P(j | k); after one of class i: log P(k | i), less the class's own size
    fit[0 : 2 * n_classes : 2] = to.T
    fit[1 : 2 * n_classes : 2] = by.T
    fit[:, 0] = -np.inf
    shared = contexts.sparkSession.sparkContext.broadcast(fit)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        for batch in batches:
            lists = batch.column("e")
            if not len(lists):
                continue
            starts = lists.offsets.to_numpy()[:-1]
            flat = lists.values
            code, n = flat.field("code").to_numpy(), flat.field("n").to_numpy()
            cls = np.empty(len(lists), np.int32)
            for at in range(0, len(lists), 5000):
                lo, hi = starts[at], starts[at + 5000] if at + 5000 < len(lists) else len(code)
                cls[at : at + 5000] = np.add.reduceat(fit[code[lo:hi]] * n[lo:hi, None], starts[at : at + 5000] - lo, axis=0).argmax(1)
            c = np.add.reduceat(np.where(code % 2 == 0, n, 0), starts)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c), pa.array(cls), lists], names=["word", "c", "cls", "e"])

    n = shuffle_partitions(contexts.sparkSession)
    # a word here has under exchange_share of the tokens, so none is hot; one exchange serves both sums
    summed = contexts.repartition(n, "word").groupBy("word", "code").agg(F.sum("c").alias("n"))
    whole = summed.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("e"))  # 2 x classes + 2 at most
    return whole.mapInArrow(choose, "word binary, c bigint, cls int, e array<struct<code: bigint, n: bigint>>")


def train(docs: DataFrame, classes: int = 64, exchange_share: float = 2e-5, lookup_share: float = 1e-6, rounds: int = 4, discount: float = 0.6, prior: float = 20.0, text: str = "text") -> Model:
    """Count, cluster and smooth over all of ``docs``."""
    spark = docs.sparkSession
    table = materialize(count_words(docs, text), "words")
    tokens, words = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known = table.filter(F.col("c") >= F.lit(exchange_share * tokens)).toPandas()  # 1 / exchange_share rows at most
    known = known.assign(word=[bytes(w) for w in known.word]).sort_values(["c", "word"], ascending=[False, True])
    known = known[known.word != END]
    ends = int(table.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    index = {END: 0} | {w: i + 1 for i, w in enumerate(known.word)}
    n, other = len(index), classes  # the symbol of all rarer words, and a class for it alone while others are exchanged
    pairs = materialize(count_pairs(docs, spark.sparkContext.broadcast(index), n + 1, text), "pairs")
    core = min(n, CORE)
    inner = _columns(pairs.filter((F.col("a") < core) & (F.col("b") < core)).select(*[F.col(x).cast("int") for x in "ab"], "c"))  # core x core rows at most
    at = np.r_[0, 1 + np.arange(n - 1) % (classes - 1), other].astype(np.int64)
    at[:core] = exchange(at[:core], *inner, classes)
    del inner
    own = np.zeros(n + 1)
    same, c = _columns(pairs.filter("a = b").select("a", "c"))
    own[same] = c
    at[core:n] = classes + 1  # not in any class yet
    count = lambda x: neighbours(pairs, x, classes + 2)
    if core < n:
        later = np.arange(core, n)
        right, left = count(at)
        blind = [classes, classes + 1]
        right[:, blind], left[:, blind] = 0, 0
        at[later] = best_moves(at, later, right, left, np.zeros(n + 1), classes)[0]
    at, right, _ = exchange_batches(at, np.arange(1, n), own, classes, count, rounds)
    met = bigrams_of(at, right)
    shared = spark.sparkContext.broadcast((index, at[:n]))
    rare = materialize(_assign(_contexts(docs, shared, other, text), met, classes), "rare-words")
    # class bigrams of all words: those of exchanged words, of these and rare ones, and of two rare ones in proportion to both
    final = met[:classes, :classes].copy()
    before, after = np.zeros(classes), np.zeros(classes)
    told = rare.select("cls", F.explode("e").alias("e")).groupBy("cls", "e.code").agg(F.sum("e.n").alias("n")).toPandas()
    for k, code, m in zip(told.cls, told.code, told.n):
        j, left_side = code // 2, code % 2
        if j == other:
            (after if left_side else before)[k] += m
        elif left_side:
            final[j, k] += m
        else:
            final[k, j] += m
    if before.sum():
        final += np.outer(before, after) / after.sum()
    seen = rare.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")).toPandas()
    sizes, members, once = np.bincount(at[:n], np.r_[ends, known.c], classes), np.bincount(at[:n], minlength=classes), np.zeros(classes)
    k = seen.cls.to_numpy(np.int64)
    sizes[k], members[k], once[k] = sizes[k] + seen.c, members[k] + seen.v, seen.once
    members[0] = once[0] = -1
    unseen_class = int(np.lexsort((members, once))[-1])
    share = (sizes + 0.5) / (sizes.sum() + 0.5 * classes)
    transition = (final + prior * share) / (final.sum(1, keepdims=True) + prior)
    rare = rare.select("word", "c", "cls")
    more = rare.filter(F.col("c") >= F.lit(lookup_share * tokens)).toPandas()  # 1 / lookup_share rows at most
    index = index | {bytes(w): n + i for i, w in enumerate(more.word)}
    counts = np.r_[ends, known.c, more.c].astype(np.int64)
    of_word = np.r_[at[:n], more.cls].astype(np.int64)
    return Model(index, counts, of_word, n, np.log10(transition), sizes, unseen_class, int(max(members[unseen_class], 0)), int(tokens), int(words), discount, rare)


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, base_score, score (log10 probability of the text) and perplexity per row."""
    m, spark, names = model, docs.sparkSession, list(keep)
    room = m.tokens + m.words + 1.0
    base = np.log10((m.counts + 1) / room)
    shared = spark.sparkContext.broadcast((m.index, m.classes, m.transition, m.emission(m.classes, m.counts), base, m.counts > 0))
    fields = ", ".join(f"{n} {t}" for n, t in docs.select(*[c.alias(n) for n, c in keep.items()]).dtypes)
    sums = "n_tokens bigint, n_known bigint, base_score double, score double, row_key bigint"
    lists = "rare array<binary>, which array<int>, before array<int>, after array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the words that are looked up; for the others, their distinct words, and of each occurrence which it is and the
        classes beside it (a rare word before as -1 less its place, one after as -1: that one counts the pair)."""
        index, classes, transition, emission, base, seen = shared.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, words, sizes in _tokens(batch):
                place = _places(words, index, -1)
                hit = place >= 0
                ends = np.cumsum(sizes)
                starts = ends - sizes
                rare = np.flatnonzero(~hit)
                cut = np.searchsorted(rare, np.r_[starts, len(words)])
                which, found = np.zeros(len(rare), np.int64), []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    ids: dict[bytes, int] = {}
                    which[a:b] = [ids.setdefault(words[i], len(ids)) for i in rare[a:b].tolist()]
                    found.append(list(ids))
                cls = np.where(hit, classes[place], 0)
                cls[rare] = -1 - which
                prev = np.r_[0, cls[:-1]]
                prev[starts] = 0
                both = hit & (prev >= 0)
                part = np.where(hit, emission[place], 0.0) + np.where(both, transition[np.maximum(prev, 0), np.maximum(cls, 0)], 0.0)
                total = lambda x: np.add.reduceat(x, starts)
                n = len(sizes)
                after = cls[rare + 1]  # a text ends in END, which is looked up
                offsets = pa.array(cut.astype(np.int32))
                ints = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (which, prev[rare], np.maximum(after, -1))]
                cols = [sizes.astype(np.int64), total((hit & seen[place]).astype(np.int64)), total(np.where(hit, base[place], 0.0)), total(part), np.arange(key, key + n)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(name).slice(at, n) for name in names], *map(pa.array, cols), pa.array(found, pa.list_(pa.binary())), *ints],
                    names=[*names, "n_tokens", "n_known", "base_score", "score", "row_key", "rare", "which", "before", "after"],
                )
                key += n

    rows = docs.select(*[c.alias(n) for n, c in keep.items()], _body(docs, text))
    partly = materialize(rows.mapInArrow(run, f"{fields}, {sums}, {lists}"), "scored")
    asked = partly.select("row_key", F.posexplode("rare").alias("k", "word"))
    told = asked.join(m.rare, "word", "left").select("row_key", F.struct("k", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("cls", F.lit(m.unseen_class)).alias("cls")).alias("t"))
    told = told.groupBy("row_key").agg(F.collect_list("t").alias("told"))  # the distinct rare words of one text
    none = F.array().cast("array<struct<k: int, c: bigint, cls: int>>")
    whole = partly.drop("rare").join(told, "row_key", "left").drop("row_key").withColumn("told", F.coalesce("told", none))
    small = spark.sparkContext.broadcast(replace(m, index={}, rare=None))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add what the rarer words bring."""
        m = small.value
        for batch in batches:
            rows = batch.num_rows
            sizes = np.diff(batch.column("told").offsets.to_numpy())
            first, told = np.cumsum(sizes) - sizes, batch.column("told").flatten()
            at = np.repeat(first, sizes) + told.field("k").to_numpy()
            cls, c = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            cls[at], c[at] = told.field("cls").to_numpy(), told.field("c").to_numpy()
            which, before, after = (batch.column(x).flatten().to_numpy() for x in ("which", "before", "after"))
            row = np.repeat(np.arange(rows), np.diff(batch.column("which").offsets.to_numpy()))
            place = first[row] + which
            mine, n = cls[place], c[place]
            prev = before.astype(np.int64)
            rare = np.flatnonzero(before < 0)
            prev[rare] = cls[first[row[rare]] - 1 - before[rare]]
            value = m.emission(mine, n) + m.transition[prev, mine] + np.where(after >= 0, m.transition[mine, np.maximum(after, 0)], 0.0)
            add = lambda x: np.bincount(row, x, rows)
            tokens = batch.column("n_tokens").to_numpy()
            score = batch.column("score").to_numpy() + add(value)
            cols = [
                batch.column("n_tokens"),
                pa.array(batch.column("n_known").to_numpy() + add((n > 0).astype(float)).astype(np.int64)),
                pa.array(np.full(rows, m.tokens, np.int64)),
                pa.array(batch.column("base_score").to_numpy() + add(np.log10((n + 1) / room))),
                pa.array(score),
                pa.array(10.0 ** np.minimum(-score / tokens, 300)),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *cols], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return whole.mapInArrow(finish, f"{fields}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")

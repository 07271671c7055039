"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most two bits, so one of
their two halves differs in at most t = 1 bit. In each half the anchors are the codewords
of the perfect [31,26] Hamming code on its first 31 bits, whose covering radius
is 1: every fingerprint lies within 1 of an anchor, and one that differs from it
in t bits lies within 1 + t of the same anchor. So each distinct fingerprint is
replicated to all anchors within 1 + t per half (16 at most), and all
links appear at some anchor, where the full 64 bits are compared.

Wide fingerprints (``bits`` 256, of distinct shingles) are for shingle similarities down to 0.8, which 64 bits at a small
distance can't tell: they are cut into eight words with the same anchors each. Pairs up to 15 bits apart always share an
anchor (one of eight words differs in at most one bit); of pairs further apart those that do are found. For these, the bits
are cut again in other orders (``sets``). Their distance only picks candidates: with a ``similarity``, a pair links if its
sets of distinct shingles, read from the texts, are that similar. A similarity of 0.8 is 15 percent of the bits on average
(19 for texts of five shingles), 38 of 256, and varies by 6; the default limit is 72.

Rows are first reduced to distinct fingerprints, so exact copies never meet in an
anchor. At an anchor with n fingerprints, pairs are compared up to a few hundred;
beyond, each probes the sorted cell with the 64-bit patterns of at most two bits, work in
proportion to n. An anchor emits the chain that connects what it has linked, under
n rows, never all pairs. Chains are joined into components in the tasks that read them, then by minimum labels, written to a scratch table in each round.

Wide: of each member the pairs with its ``NEAREST`` are tried, then with its nearest of other components. One that had more of
those is crowded, as pages of one template are, and all links between crowded ones of different components are found by an
exact join of their sets of shingles (:func:`crowd_links`). So no candidate is left untried for want of a place.

Defined results: null text counts as empty, a text without words has fingerprint
zero, which links like any other; long texts are read whole; a bit that is set in
just half the hashes is not set; a null id can't name a component while another
row of the component has an id; repeated rows get one row each; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import keep_rows, materialize, row_id, shuffle_partitions, with_row_id

SEED = 42
#: Cells up to this size compare all pairs; larger ones probe by patterns, which is exact too.
PAIRWISE = 512
#: Shingle bits are summed in groups of this many.
_GROUP = 4096
#: A wide fingerprint is a candidate with so many of the nearest others that share an anchor, in either round.
NEAREST = 8
#: So many of them come from one anchor with over ``NEAREST`` fingerprints; two that are near share many anchors.
CELL_NEAREST = 1
#: A task puts stars in place of so many edges at a time, and so bounds what it holds.
HELD = 1 << 18
#: The nearest are sought among so many fingerprints of a cell, in their order, at a time.
SLICE = 4096


def simhash(text: bytes, width: int) -> int:
    """Fingerprint of the ``width``-word shingles of a text in bytes; bit i is set if it is in over half the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    ends = ends.tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _GROUP):
        some = zip(starts[at : min(n, at + _GROUP)], ends[at + width - 1 :])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in some], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def shingles(text: bytes, width: int) -> set[bytes]:
    """The distinct ``width``-word shingles of a text; a shorter one is its own, one without words has none."""
    words = text.lower().split()
    if not words:
        return set()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    return {joined[a:b] for a, b in zip(starts, ends[min(width, len(words)) - 1 :].tolist())}


def wide_simhash(text: bytes, width: int, bits: int) -> bytes:
    """As :func:`simhash` of distinct shingles, with XXH3-128 under as many seeds as fill ``bits``."""
    found, seeds, digest = list(shingles(text, width)), range(SEED, SEED + bits // 128), xxhash.xxh3_128_digest
    if not found:
        return bytes(bits // 8)
    ones, n = np.zeros(bits, np.int64), len(found)
    for at in range(0, n, _GROUP):
        some = found[at : at + _GROUP]
        raw = b"".join([digest(x, s) for x in some for s in seeds])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def wide_fingerprints(docs: DataFrame, width: int, bits: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, row`` of each row; fp is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [wide_simhash(t or b"", width, bits) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.binary()), batch.column("row")], names=["doc_id", "fp", "row"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), row_id(docs).alias("row"), docs[text].cast("string").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id bigint, fp binary, row struct<file: string, pos: bigint>")


def fingerprints(docs: DataFrame, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, row`` of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t or b"", width) for t in batch.column("body").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), batch.column("row")], names=["doc_id", "fp", "row"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), row_id(docs).alias("row"), docs[text].cast("string").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, row struct<file: string, pos: bigint>")


def _syndromes(half: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the XOR of the (1-based) places of their set bits; 0 for a codeword."""
    out = np.zeros(len(half), np.int64)
    for place in range(1, 32):
        out ^= np.where(half >> np.uint64(place - 1) & np.uint64(1), place, 0)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and codeword for every codeword within 2 of each 31-bit word.

    A codeword is alone there; else the word is one flip from its codeword, and
    two flips lead to another wherever the two places XOR to the syndrome.
    """
    one = np.uint64(1)
    bit = lambda place: one << (place.astype(np.uint64) - one)
    s, index = _syndromes(half), np.arange(len(half))
    exact, off = s == 0, s != 0
    out_i, out_a = [index[exact], index[off]], [half[exact], half[off] ^ bit(s[off])]
    for place in range(1, 32):
        other = s ^ place
        pick = off & (other > place)
        out_i.append(index[pick])
        out_a.append(half[pick] ^ bit(np.full(pick.sum(), place)) ^ bit(other[pick]))
    return np.concatenate(out_i), np.concatenate(out_a)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64((1 << 31) - 1)
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        keys, kept = [], []
        for part, shift in ((0, 0), (1, 32)):
            i, a = anchors(fps >> np.uint64(shift) & low)
            keys.append(a.astype(np.int64) * 2 + part)
            kept.append(fps[i].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(kept))], names=["anchor", "fp"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of n nodes under links a-b, named by its smallest member."""
    label = np.arange(n)
    while True:
        of_a, of_b = label[a], label[b]
        low = np.minimum(of_a, of_b)
        np.minimum.at(label, of_a, low)
        np.minimum.at(label, of_b, low)
        new = label[label]
        while not np.array_equal(new, label):
            label, new = new, new[new]
        if np.array_equal(label[a], label[b]):
            return label


def _links(cell: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a sorted cell of distinct fingerprints that differ in at most ``distance`` bits."""
    n = len(cell)
    if n <= PAIRWISE:
        near = np.bitwise_count(cell[:, None] ^ cell[None, :]) <= distance
        return np.nonzero(np.triu(near, 1))
    one, out_a, out_b = np.uint64(1), [], []
    singles = [one << np.uint64(i) for i in range(64)]
    patterns = singles + [x ^ y for i, x in enumerate(singles) for y in singles[:i]] if distance > 1 else singles
    for mask in patterns:
        want = cell ^ mask
        at = np.minimum(np.searchsorted(cell, want), n - 1)
        hit = np.flatnonzero((cell[at] == want) & (want > cell))
        out_a.append(hit)
        out_b.append(at[hit])
    return np.concatenate(out_a), np.concatenate(out_b)


def _whole_cells(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their rows, cut between keys only: a cell over many batches is put together once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    join = lambda parts: tuple(map(np.concatenate, zip(*parts)))
    for k, f in batches:
        cut = np.searchsorted(k, k[-1]) if len(k) else 0  # the last cell may go on
        if held and len(k) and k[0] != held[-1][0][-1]:
            yield join(held)
            held = []
        if cut:
            yield join([*held, (k[:cut], f[:cut])])
            held = []
        if len(k):
            held.append((k[cut:], f[cut:]))
    if held:
        yield join(held)


def _compare(distance: int):
    def chains(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Connecting links of whole cells, sorted by anchor."""
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[starts, len(anchor)])
        out_a, out_b = [], []
        place = np.arange(len(anchor)) - np.repeat(starts, sizes)
        room = np.repeat(sizes, sizes) - place
        small = np.repeat(sizes <= 8, sizes)
        for step in range(1, 8):
            i = np.flatnonzero(small & (room > step))
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
            out_a.append(fp[i])
            out_b.append(fp[i + step])
        for at in np.flatnonzero(sizes > 8):
            cell = np.sort(fp[starts[at] : starts[at] + sizes[at]])
            a, b = _links(cell, distance)
            if len(a):
                root = _roots(len(cell), a, b)
                order = np.lexsort((np.arange(len(cell)), root))
                same = np.flatnonzero(root[order][1:] == root[order][:-1])
                out_a.append(cell[order[same]])
                out_b.append(cell[order[same + 1]])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, f in _whole_cells((b.column("anchor").to_numpy(), b.column("fp").to_numpy().view(np.uint64)) for b in batches):
            yield chains(k, f)

    return run


def _words(column: pa.Array, size: int) -> np.ndarray:
    """A binary column of equal lengths as rows of ``size`` 64-bit words."""
    n, at = len(column), column.offset
    return np.frombuffer(column.buffers()[2], "<u8", n * size, 8 * at * size).reshape(n, size) if n else np.zeros((0, size), "<u8")


def _binary(words: np.ndarray) -> pa.Array:
    step = 8 * words.shape[1]
    ends = np.arange(0, (len(words) + 1) * step, step, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words))])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _nearest(cell: np.ndarray, label: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members of a cell with their nearest ones of another label within ``distance``, and the members whose pairs may not all be there.

    Where one label has most members, the others seek alone.
    """
    a, b, crowded = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(cell), bool)
    if len(cell) > SLICE and len(np.unique(label)) > 1:
        crowded[:] = True
    for start in range(0, len(cell), SLICE):
        some, own = cell[start : start + SLICE], label[start : start + SLICE]
        names, sizes = np.unique(own, return_counts=True)
        if len(names) == 1:
            continue
        common = names[np.argmax(sizes)]
        seekers = np.flatnonzero(own != common) if 2 * sizes.max() > len(some) else np.arange(len(some))
        most = min(CELL_NEAREST, len(some) - 1)
        for at in range(0, len(seekers), 64):
            who = seekers[at : at + 64]
            apart = _apart(some[who, None], some[None])
            apart[own[who, None] == own[None]] = 1 << 30
            within = apart <= distance
            full = within.sum(1) > most
            crowded[start + who[full]] = True
            crowded[start : start + len(some)] |= within[full].any(0)
            near = np.argpartition(apart, most - 1, axis=1)[:, :most]
            i, j = np.nonzero(np.take_along_axis(apart, near, 1) <= distance)
            a.append(start + who[i])
            b.append(start + near[i, j])
    one, other = np.concatenate(a), np.concatenate(b)
    codes = np.unique(np.minimum(one, other) * len(cell) + np.maximum(one, other))
    return codes // len(cell), codes % len(cell), np.flatnonzero(crowded)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs within are removed at its end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def wide_links(fps: DataFrame, bits: int, distance: int, sets: int = 1) -> tuple[DataFrame, DataFrame]:
    """``a, b``: pairs among distinct binary ``fp`` of different ``label`` that share an anchor and differ in at most ``distance`` bits;
    and the crowded ``fp``: a pair that isn't among the first is one of two crowded ones.

    Of each fingerprint's pairs the ``NEAREST`` closest are kept, and those that its partners keep. Anchors are those of the bits
    in ``sets`` orders, one after the other; the shuffle files of each are removed at once.
    """
    with tidy_shuffles(fps.sparkSession):
        found = [materialize(_wide_links(fps, bits, distance, k), "candidates") for k in range(sets)]
    return _closest(functools.reduce(DataFrame.unionByName, found))


def _closest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``a, b, apart, marks``: the pairs ``a, b`` among the ``NEAREST`` of either end, and the ``fp`` that had more or that a mark names
    as crowded. Spark trims each end's pairs map-side."""
    met = pairs.filter("a <> b").select("a", "b", "apart").distinct()
    ends = met.select("apart", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("e"))
    order = Window.partitionBy("own").orderBy("apart", "other")
    ranked = ends.select("e.own", "e.other", "apart").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= NEAREST + 1)
    ranked = materialize(ranked.select("own", "other", "r"), "nearest")
    kept = ranked.filter(F.col("r") <= NEAREST).select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()
    marked = pairs.filter("marks > 0").select(F.explode(F.expr("filter(array(if(marks & 1 > 0, a, null), if(marks & 2 > 0, b, null)), x -> x is not null)")).alias("fp"))
    return kept, ranked.filter(F.col("r") > NEAREST).select(F.col("own").alias("fp")).unionByName(marked).distinct()


def _wide_links(fps: DataFrame, bits: int, distance: int, turn: int) -> DataFrame:
    """``a, b, apart, marks``: the pairs by the anchors of one order of the bits (their own if ``turn`` is 0). Marks has 1 where a is crowded, 2 where b is;
    a crowded one that is in none of its cell's pairs is a pair with itself."""
    size, low = bits // 64, np.uint64((1 << 31) - 1)
    order = np.random.default_rng(turn).permutation(bits) if turn else np.arange(bits)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, label = _words(batch.column("fp"), size), batch.column("label").to_numpy()
            for at in range(0, len(words), 5000):
                some, own = words[at : at + 5000], label[at : at + 5000]
                dealt = np.ascontiguousarray(np.packbits(np.unpackbits(some.view(np.uint8), axis=1)[:, order], axis=1)).view("<u8") if turn else some
                for part in range(2 * size):
                    i, a = anchors(dealt[:, part // 2] >> np.uint64(32 * (part % 2)) & low)
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64) * 2 * size + part), _binary(some[i]), pa.array(own[i])], names=["anchor", "fp", "label"])

    def pairs(anchor: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        fp, label = np.ascontiguousarray(rows[:, :size]), rows[:, size]
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[starts, len(anchor)])
        place = np.arange(len(anchor)) - np.repeat(starts, sizes)
        room, few = np.repeat(sizes, sizes) - place, np.repeat(sizes <= NEAREST, sizes)
        a, b, more = [], [], np.zeros(len(anchor), bool)
        for step in range(1, NEAREST):
            i = np.flatnonzero(few & (room > step))
            i = i[(_apart(fp[i], fp[i + step]) <= distance) & (label[i] != label[i + step])]
            a.append(i)
            b.append(i + step)
        for at in np.flatnonzero(sizes > NEAREST):
            cell = slice(starts[at], starts[at] + sizes[at])
            i, j, crowded = _nearest(fp[cell], label[cell], distance)
            more[starts[at] + crowded] = True
            alone = np.setdiff1d(crowded, np.r_[i, j])
            a += [starts[at] + i, starts[at] + alone]
            b += [starts[at] + j, starts[at] + alone]
        i, j = np.concatenate(a), np.concatenate(b)
        one, other = fp[i], fp[j]
        first = (np.arange(len(i)), (one != other).argmax(1))
        i, j = np.where(one[first] > other[first], (j, i), (i, j))  # each pair in one order
        one, other, marks = fp[i], fp[j], more[i] + 2 * more[j]
        return pa.RecordBatch.from_arrays([_binary(one), _binary(other), pa.array(_apart(one, other).astype(np.int32)), pa.array(marks.astype(np.int32))], names=["a", "b", "apart", "marks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("anchor").to_numpy(), np.c_[_words(b.column("fp"), size), b.column("label").to_numpy().view(np.uint64)]) for b in batches)
        for k, f in _whole_cells(rows):
            yield pairs(k, f)

    n = shuffle_partitions(fps.sparkSession)
    cells = fps.select("fp", "label").mapInArrow(replicate, "anchor bigint, fp binary, label bigint").repartition(n, "anchor").sortWithinPartitions("anchor", "fp")
    both = cells.mapInArrow(compare, "a binary, b binary, apart int, marks int")
    return both.groupBy("a", "b", "apart").agg(F.bit_or("marks").alias("marks"))


def similar_links(nodes: DataFrame, docs: DataFrame, width: int, bits: int, distance: int, sets: int, similarity: float | None, text: str = "text") -> DataFrame:
    """``a, b``: links among the ``fp`` of ``nodes(fp, least)``: candidates by anchors, confirmed by the texts' shingles where a ``similarity`` is given.

    First each fingerprint's nearest candidates are tried. Those that link make components, and in a second round each one's
    nearest candidates of other components are. Those that had more of them are tried in full by :func:`crowd_links`.
    """
    confirm = lambda edges: edges if similarity is None else materialize(confirmed(materialize(edges, "candidates"), nodes, docs, width, similarity, text), "links")
    first = confirm(wide_links(nodes.select("fp", F.xxhash64("fp").alias("label")), bits, distance, sets)[0])
    pairs, crowded = wide_links(labels(nodes, first), bits, distance, sets)
    found = first.unionByName(confirm(pairs))
    if similarity is None:
        return found
    return found.unionByName(crowd_links(materialize(crowded, "crowded"), nodes, docs, found, width, similarity, text))


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, label`` of all ``nodes``: a number for their component under ``edges(a, b)``."""
    parts = components(nodes.select(F.col("fp").alias("node")), edges)
    return materialize(parts.select(F.col("node").alias("fp"), F.xxhash64("component").alias("label")), "labels")


def crowd_links(crowd: DataFrame, nodes: DataFrame, docs: DataFrame, found: DataFrame, width: int, similarity: float, text: str = "text") -> DataFrame:
    """``a, b``: links between components of ``found`` among the fingerprints of ``crowd(fp)``, all of them: an exact join of their sets of shingles.

    A set's shingles are ordered by how many sets of the crowd hold them, rarest first, so what a template puts into all of
    them comes last. Two sets of sizes m and n that are similar enough share s / (1 + s) x (m + n) shingles, so the first that they
    share leaves as many from it on in either; sets meet by an equi join on the shingles that may be such a first one, where both places
    and sizes allow it. Shingles of one set or one component meet nobody. Two sets of a component stand for it at a shingle in a
    first round; all do in the second, when such components have become one.
    """
    if crowd.isEmpty():
        return found.limit(0)
    sets = shingle_sets(crowd, nodes, docs, width, text)
    each = sets.select("fp", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    held = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-shingles")
    shared = each.join(held, "h")
    by_set = Window.partitionBy("fp")
    place = F.col("n") - F.count(F.lit(1)).over(by_set) + F.row_number().over(by_set.orderBy("df", "h")) - 1  # after those of no other set
    first = shared.select("fp", "n", "h", place.alias("i")).filter(F.col("n") - F.col("i") + 1e-6 >= similarity * F.col("n"))
    first = materialize(first, "first-shingles")
    out = []
    for standing in (2, None):
        named = first.join(labels(nodes, functools.reduce(DataFrame.unionByName, out, found)), "fp")
        if standing:
            named = named.withColumn("r", F.row_number().over(Window.partitionBy("h", "label").orderBy("i", "fp"))).filter(F.col("r") <= standing).drop("r")
        mixed = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("h")
        named = materialize(named.join(mixed, "h", "left_semi"), "mixed-shingles")
        x, y = (named.select("h", *[F.col(c).alias(c + end) for c in ("fp", "n", "i", "label")]) for end in ("_x", "_y"))
        fits = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y")) + 1e-6 >= similarity / (1 + similarity) * (F.col("n_x") + F.col("n_y"))
        pairs = x.join(y, "h").filter((F.col("label_x") < F.col("label_y")) & fits)
        pairs = pairs.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b")).distinct()
        out.append(materialize(similar_pairs(materialize(pairs, "crowd-pairs"), sets, similarity), "crowd-links"))
    return functools.reduce(DataFrame.unionByName, out)


def confirmed(edges: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float, text: str = "text") -> DataFrame:
    """The ``edges`` whose texts' sets of distinct shingles have a Jaccard similarity of ``similarity`` at least."""
    linked = edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    return similar_pairs(edges, shingle_sets(linked, nodes, docs, width, text), similarity)


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``fp, shingles``: hashes of the distinct shingles of the text of each ``wanted(fp)``; ``nodes(fp, least)`` names a row of ``docs`` for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = batch.slice(at, 100)
                sets = [np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in shingles(t or b"", width)), np.uint64)).view(np.int64) for t in some.column("body").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([some.column("fp"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["fp", "shingles"])

    named = nodes.join(wanted, "fp", "left_semi").select("fp", F.col("least.row.file").alias("f"), F.col("least.row.pos").alias("p"))
    rows = docs.select(row_id(docs).alias("row"), docs[text].cast("string").cast("binary").alias("body"))
    texts = rows.join(named, (F.col("row.file") == F.col("f")) & (F.col("row.pos") == F.col("p"))).select("fp", "body")
    return materialize(texts.mapInArrow(run, "fp binary, shingles array<bigint>"), "shingles")


def similar_pairs(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``edges`` whose ``sets(fp, shingles)`` have a Jaccard similarity of ``similarity`` at least."""
    pairs = edges.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b")), "b")
    counted = pairs.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return counted.filter(F.col("both") + 1e-6 >= similarity * (F.col("sizes") - F.col("both"))).select("a", "b")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b``: links among the distinct ``fp`` that connect all within ``distance`` (1 or 2) bits of one another."""
    if distance not in (1, 2):
        raise ValueError("64-bit fingerprints link at a distance of 1 or 2")
    n = shuffle_partitions(fps.sparkSession)
    cells = fps.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint").repartition(n, "anchor").sortWithinPartitions("anchor")
    return cells.mapInArrow(_compare(distance), "a bigint, b bigint").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """``v, u``: stars in place of the ``edges(v, u)`` that a task reads, each from its members to the smallest; they connect what the edges do.

    A task holds ``HELD`` edges at a time, and goes on with their stars while these are no more than half as many.
    """
    kind = dict(edges.dtypes)["v"]

    def stars(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts)
        n = len(table)
        codes = pa.chunked_array(table.column("v").chunks + table.column("u").chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(codes.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = rank[codes.indices.to_numpy()]
        root = _roots(len(order), ends[:n], ends[n:])
        v = np.flatnonzero(root != np.arange(len(root)))
        names = codes.dictionary.take(pa.array(order))
        return pa.table([names.take(pa.array(v)), names.take(pa.array(root[v]))], names=["v", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= HELD:
                held = [stars(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from stars(held).to_batches()

    return edges.mapInArrow(run, f"v {kind}, u {kind}")


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges(v, u)`` is either a centre or has a single one."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.agg(F.max((F.col("up") > 0).cast("int") * (F.col("up") + F.col("down")))).first()[0] in (None, 1)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges(a, b)`` reaches.

    Tasks put stars in place of the edges they read (:func:`contracted`), again and again while that leaves fewer; the later tasks are
    as many as those edges fill, ``HELD`` to each.
    Where that leaves more than stars: every node links to the least of its neighbours, larger ones first (large-star), then
    smaller ones (small-star), and so on. Minima are taken map-side and their joins can be split, so a node with very
    many links is no one task's work. Shuffles are few, whatever their number of partitions.
    """
    edges = edges.filter("a <> b").selectExpr("greatest(a, b) AS v", "least(a, b) AS u")
    while True:
        before, n = None, None
        while before is None or n < 0.9 * before:
            some = edges if n is None else edges.coalesce(-(-n // HELD) or 1)
            edges = materialize(contracted(some), "edges")
            before, n = n, edges.count()
        if _all_stars(edges):
            return nodes.join(edges.select(F.col("v").alias("node"), F.col("u").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = materialize(both.groupBy("v").agg(F.min("u").alias("m")).selectExpr("v", "least(v, m) AS m"), "least")
        large = materialize(both.filter("u > v").join(least, "v").selectExpr("u AS v", "m AS u").filter("v <> u"), "large-star")
        down = materialize(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(down, "v").selectExpr("explode(if(u = m, array(struct(v, m AS u)), array(struct(u AS v, m AS u)))) AS e").select("e.v", "e.u")
        edges = small.filter("v <> u").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 2, bits: int = 64, similarity: float | None = None, sets: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, component_id, row`` of each row; component_id is the smallest id its links reach.

    Wide fingerprints with a ``similarity`` link where the texts' distinct shingles confirm it.
    """
    if bits != 64 and bits % 128:
        raise ValueError("bits: 64, or a multiple of 128")
    docs = with_row_id(docs)
    raw = fingerprints(docs, width, text, doc_id) if bits == 64 else wide_fingerprints(docs, width, bits, text, doc_id)
    found = materialize(raw, "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")), "distinct-fingerprints")
    with tidy_shuffles(docs.sparkSession):
        edges = links(nodes, distance) if bits == 64 else similar_links(nodes, docs, width, bits, distance, sets, similarity, text)
        whole = components(nodes.select(F.col("fp").alias("node")), edges)
        whole = materialize(whole.join(nodes.select(F.col("fp").alias("node"), "least"), "node"), "components")
        best = whole.groupBy("component").agg(F.min("least").alias("best"))
        named = materialize(whole.join(materialize(best, "best"), "component").select(F.col("node").alias("fp"), "best"), "names")
    return found.join(named, "fp").select("doc_id", "fp", F.col("best.doc_id").alias("component_id"), "row", F.col("best.row").alias("best_row"))


def one_of_each(docs: DataFrame, width: int = 5, distance: int = 72, bits: int = 256, similarity: float = 0.8, sets: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that name their component, all columns. By default a similarity of distinct five-word shingles of 0.8 links; with 64 bits their distance does."""
    docs = with_row_id(docs)
    rows = near_duplicates(docs, width, distance, bits, similarity, sets, text, doc_id)
    return keep_rows(docs, rows.filter(F.col("row").eqNullSafe(F.col("best_row"))).select("row"))

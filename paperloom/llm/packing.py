"""Packing token sequences: bounded-space best-fit with a fixed number of open windows.

Each partition streams its documents: a document longer than a window is cut
into full windows, its rest goes to the open window that it fits best; where none
fits and no more may be opened, the fullest is topped up with the start of the
document and emitted. At the end of a partition its open windows are merged into
full ones; what remains of it, less than one window, is carried with its ids and
merged across partitions by a prefix sum over one total per partition.

Defined results: null text counts as empty (the end id alone is packed); null
ids and repeated rows are packed like any other; long texts are cut into as many
windows as they fill; of windows with equal room the oldest is taken; an empty
table gives an empty result; other columns are ignored whatever their names. All
sequences but the corpus' last are full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize
from paperloom.llm.token_store import slices
from paperloom.llm.tokens import as_bytes, encoder

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, part int, sequence int, offset bigint, ids binary"
_LAST = 1 << 62


class Packer:
    """The windows of one partition. ``out`` collects ``(piece, sequence, offset)`` of emitted ones; pieces are ``(doc, start, ids)``."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: list[tuple[int, int]] = []  # (room, key), by room
        self.held: dict[int, list] = {}
        self.keys = self.sequences = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.out.append((p, self.sequences, at))
            at += len(p[2]) // 4
        self.sequences += 1

    def add(self, doc, ids: bytes) -> None:
        start, total = 0, len(ids) // 4
        while total - start >= self.size:
            self._emit([(doc, start, ids[4 * start : 4 * (start + self.size)])])
            start += self.size
        while start < total:
            left = total - start
            at = bisect_left(self.open, (left, -1))
            if at < len(self.open):
                room, key = self.open.pop(at)
                take = left
            elif len(self.open) < self.windows:
                room, key, take = self.size, self.keys, left
                self.keys += 1
                self.held[key] = []
            else:  # none fits: the fullest is filled up and goes
                room, key = self.open.pop(0)
                take = room
            self.held[key].append((doc, start, ids[4 * start : 4 * (start + take)]))
            start += take
            if room == take:
                self._emit(self.held.pop(key))
            else:
                insort(self.open, (room - take, key))

    def finish(self) -> None:
        """Merge the open windows, fullest first; the rest of under one window is sequence -1."""
        pieces, at = [], 0
        for _, key in self.open:
            for doc, start, ids in self.held[key]:
                while at + len(ids) // 4 >= self.size:
                    cut = self.size - at
                    self._emit([*pieces, (doc, start, ids[: 4 * cut])])
                    start, ids, pieces, at = start + cut, ids[4 * cut :], [], 0
                if ids:
                    pieces.append((doc, start, ids))
                    at += len(ids) // 4
        at = 0
        for p in pieces:
            self.out.append((p, -1, at))
            at += len(p[2]) // 4


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 4096, windows: int = 64, text: str = "text", doc_id: str = "doc_id", spaced: bool = False, lower: bool = True) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (ids: little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer = TaskContext.get().partitionId(), Packer(size, windows)

        def emitted() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            cols = [
                [p[0][0] for p, _, _ in rows], [p[1] for p, _, _ in rows], [len(p[2]) // 4 for p, _, _ in rows], [p[0][1] for p, _, _ in rows],
                [part] * len(rows), [s for _, s, _ in rows], [o for _, _, o in rows], [p[2] for p, _, _ in rows],
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "part", "sequence", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        with encoder(vocabulary, spaced, lower) as coder:
            for batch in batches:
                for a, b in slices(batch, "text"):
                    piece = batch.slice(a, b - a)
                    found = as_bytes(*coder.encode(piece.column("text").to_pylist(), end_id))
                    for doc, ids in zip(piece.column("doc_id").to_pylist(), found):
                        packer.add((doc, len(ids) // 4), ids)
                    yield emitted()
        packer.finish()
        yield emitted()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    pieces = materialize(rows.mapInArrow(run, PIECES), "pieces")
    full = pieces.filter("sequence >= 0").withColumn("sequence_id", F.shiftleft(F.col("part").cast("long"), 32) + F.col("sequence"))
    rest = pieces.filter("sequence < 0")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rest.groupBy("part").agg(F.sum("length").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per partition
    placed = rest.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("offset"))
    room = size - F.pmod(F.col("at"), F.lit(size))
    cuts = F.when(F.col("length") > room, F.array(F.struct(F.lit(0).cast("long").alias("skip"), room.alias("take")), F.struct(room.alias("skip"), (F.col("length") - room).alias("take"))))
    cuts = cuts.otherwise(F.array(F.struct(F.lit(0).cast("long").alias("skip"), F.col("length").alias("take"))))
    merged = placed.withColumn("cut", F.explode(cuts)).select(
        "doc_id",
        (F.col("start") + F.col("cut.skip")).alias("start"),
        F.col("cut.take").alias("length"),
        "doc_tokens",
        (F.lit(_LAST) + F.floor((F.col("at") + F.col("cut.skip")) / size)).alias("sequence_id"),
        F.pmod(F.col("at") + F.col("cut.skip"), F.lit(size)).alias("offset"),
        F.expr("substring(ids, cast(4 * cut.skip + 1 as int), cast(4 * cut.take as int))").alias("ids"),
    )
    return full.select(merged.columns).unionByName(merged)

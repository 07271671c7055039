"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on ids.

Documents are range-partitioned and sorted by id, encoded and written, one file
to a range, as ``doc_id, part, start_in_part, n_tokens, ids``. ORC's writer
encodes the id lists by runs and keeps, per stripe and row group, minimum,
maximum and a Bloom filter of ``doc_id``, so a reader of a few documents skips
the other stripes, and stripes are read in parallel. A document's place in the
whole corpus is its place in its file plus the files before: only one total per
file is gathered for that.

Defined results: null text counts as empty (the end id alone); null ids come
first; repeated ids follow one another, ordered by text; long texts are encoded
whole, in pieces; an empty table writes an empty dataset; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import shuffle_partitions
from paperloom.llm.tokens import encoder

STORE = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
#: Texts are encoded in groups of about this many characters.
GROUP_CHARS = 2_000_000


def slices(batch: pa.RecordBatch, column: str, most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of text each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", spaced: bool = True, files: int | None = None) -> None:
    """Encode every text and write the dataset at ``path`` in ascending id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        with encoder(vocabulary, spaced) as coder:
            for batch in batches:
                for a, b in slices(batch, "text"):
                    piece = batch.slice(a, b - a)
                    found, ends = coder.encode(piece.column("text").to_pylist(), end_id)
                    sizes = np.diff(ends, prepend=0)
                    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found.view(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), ids],
                        names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                    )
                    at += int(ends[-1])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(files or shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    (
        dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(encode, STORE)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; with ``doc_ids``, stripes without them are skipped by metadata."""
    store = spark.read.schema(STORE).orc(path)
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per file
    rows = store.filter(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else store
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what :func:`read_tokens` gives."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            kept = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

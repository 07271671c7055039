"""Exact deduplication by a persistent digest index.

The index is a table of ``digest binary, keep_id, group_size, batch`` that is bucketed
and sorted by digest; the number of its buckets is stored beside it. A batch is
reduced to one digest per distinct text before it meets the index, the sort-merge
anti-join leaves the digests that are new, and those are appended. Only 32-byte
digests, ids and counts are shuffled, never texts, and a digest that a third of
all rows share is counted map-side.

A batch joins the index before its own result is written, so a job that dies in between has to be able to run again: what
the index holds of a batch of the same name isn't known to it, and isn't appended twice. Who retries gives the batch its
name; without one, every call is a batch of its own.

Defined results: null text counts as empty; texts are equal when identical
after lower-casing A-Z, whole, however long; of equal texts the largest
``doc_id`` stays (null ids lose to any other); of repeated rows with one id,
exactly one stays; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import (
    ascii_lower,
    keep_rows,
    materialize,
    row_id,
    scratch_path,
    shuffle_partitions,
    with_row_id,
)

ENTRIES = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"


class DigestIndex:
    """Digests of all texts seen so far, at ``path`` (a new scratch path by default).

    ``buckets`` is chosen when the index is made, by default as many as shuffle partitions; an index
    that exists has its own number, and another one is refused.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digests")
        self.table = "digests_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        stored = self._stored_buckets() if path else None
        if stored and buckets and stored != buckets:
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or shuffle_partitions(spark)
        if not stored:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.json(f"{self.path}/_index")
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} ({ENTRIES}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def _stored_buckets(self) -> int | None:
        """The number in ``_index``, which readers of the table skip as a hidden file."""
        try:
            found = self.spark.read.schema("buckets int").json(f"{self.path}/_index").first()
        except AnalysisException:  # no such path
            return None
        return found["buckets"]

    def entries(self) -> DataFrame:
        """The index as a plain table; a join with it can be dealt anew where it is skewed."""
        return self.spark.read.schema(ENTRIES).parquet(self.path)

    def unseen(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """Rows of ``groups`` (one per digest) that the index doesn't hold from another batch."""
        known = self.spark.table(self.table).filter(~F.col("batch").eqNullSafe(F.lit(batch))).select("digest")
        return groups.join(known.hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add ``digest, keep_id, group_size`` as a batch, one file per bucket, but for what an earlier try of it has added."""
        own = self.entries().filter(F.col("batch") == batch).select("digest")
        tried = not own.isEmpty()
        rows = groups.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        (
            (rows.join(own, "digest", "left_anti") if tried else rows)
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.table, format="parquet")
        )


def _digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return materialize(
        docs.select(
            docs[doc_id].cast("long").alias("doc_id"),
            F.unhex(F.sha2(ascii_lower(docs[text]), 256)).alias("digest"),
            row_id(docs).alias("row"),
        ),
        "doc-digests",
    )


def _groups(digests: DataFrame) -> DataFrame:
    best = F.max(F.struct("doc_id", "row"))
    return digests.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))


def _admit(index: DigestIndex, groups: DataFrame, batch: str) -> DataFrame:
    """The ``groups`` that are new to the index, which then holds them."""
    fresh = materialize(index.unseen(groups, batch), "digest-fresh")
    index.append(fresh.select("digest", F.col("best.doc_id").alias("keep_id"), "group_size"), batch)
    return fresh


def decide(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batches: int = 1, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    ``group_size`` counts the rows of ``docs``; a text that the index held before has the ``keep_id`` of that time and no
    row kept. With more ``batches`` the rows come in as many ranges of ids, the highest first, each deduplicated against
    the index as the ones before have left it; the result is the same.
    """
    index, name = index or DigestIndex(docs.sparkSession), batch or uuid.uuid4().hex
    digests = _digests(with_row_id(docs), text, doc_id)
    cuts = []
    if batches > 1:
        shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
        cuts = sorted(set(digests.agg(F.percentile_approx("doc_id", shares)).first()[0] or []))
    range_ = F.lit(0)
    for cut in cuts:
        range_ = range_ + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    groups = [materialize(_groups(digests.filter(range_ == i) if cuts else digests), "digest-groups") for i in range(len(cuts), -1, -1)]
    fresh = [_admit(index, g, f"{name}-{i}") for i, g in enumerate(groups)]
    won = functools.reduce(DataFrame.unionByName, fresh).select("digest", "best")
    sizes = functools.reduce(DataFrame.unionByName, groups)
    if cuts:
        sizes = sizes.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    known = index.entries().select("digest", "keep_id").join(sizes.select("digest", "group_size"), "digest")
    known = materialize(known.join(won, "digest", "left"), "digest-known")
    kept = F.col("best").isNotNull() & F.col("row").eqNullSafe(F.col("best.row"))
    return digests.join(known, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def survivors(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; their digests join the index. A repeated ``batch`` (its name) has the same result."""
    index = index or DigestIndex(docs.sparkSession)
    docs = with_row_id(docs)
    fresh = _admit(index, _groups(_digests(docs, text, doc_id)), batch or uuid.uuid4().hex)
    return keep_rows(docs, fresh.select(F.col("best.row").alias("row")))

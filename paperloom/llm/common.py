"""What the training-data operators share: scratch tables, row ids and ASCII lower-casing."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written within gives Python workers Arrow batches of so many rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_id(docs: DataFrame) -> DataFrame:
    """``docs`` whose rows have a stable identity (file and position there), even when repeated.

    Rows that aren't read straight from files are written to a scratch table first.
    """
    try:
        docs.select(docs.metadataColumn("_metadata").getField("row_index")).schema
        return docs
    except AnalysisException:  # not a plain scan of files
        return materialize(docs, "rows")


def row_id(docs: DataFrame) -> Column:
    """The identity that :func:`with_row_id` provides, as an orderable struct."""
    meta = docs.metadataColumn("_metadata")
    return F.struct(meta.getField("file_path").alias("file"), meta.getField("row_index").alias("pos"))


def keep_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of ``docs`` (from :func:`with_row_id`) whose id is in ``winners(row struct)``."""
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row_id(docs).alias("row"))
    ids = winners.select(F.col("row.file").alias("f"), F.col("row.pos").alias("p"))
    found = tagged.join(ids, (F.col("row.file") == F.col("f")) & (F.col("row.pos") == F.col("p")), "left_semi")
    return found.select("doc.*")

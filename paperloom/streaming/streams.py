"""Streams over the same operators: incremental ingest, stateful rate decisions, revision de-duplication, freshness."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions import text as T
from paperloom.operators import ingest
from paperloom.operators.retrieval import small
from paperloom.session import kept
from paperloom.sources.versions import VersionedCorpus


def ingest_batch(corpus: VersionedCorpus, docs: DataFrame, stream: str, batch: int, rejected: str, cut: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Take ``docs`` (doc_id, text, source as owner) into a corpus: one commit of all four tables, or none.

    A document whose revision (the hash of its text) the corpus has is left alone; of a document's rows in one batch the greatest text counts. Those that
    the guards refuse are written to ``rejected`` with their reason, in a folder of the batch. A batch that comes again changes nothing.
    ``cut`` makes chunks (document_id, page_number, chunk_index, text) of pages.
    """
    docs = docs.select("doc_id", "text", "source")
    twice = small(kept(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("met")), "repeated"))
    same = F.col("doc_id").eqNullSafe(F.col("met"))
    best = F.max(F.struct("text", F.col("source").alias("owner"))).alias("d")
    rows = docs.join(twice, same, "left_semi").groupBy("doc_id").agg(best).select("doc_id", "d.text", F.col("d.owner").alias("source"))
    rows = docs.join(twice, same, "left_anti").unionByName(rows).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("revision", T.content_hash(F.col("text")))
    known = corpus.read("manifest")
    if known is not None:
        fresh = rows.select("doc_id", "revision").join(known.select(F.col("document_id").alias("doc_id"), "revision"), ["doc_id", "revision"], "left_anti")
        rows = rows.join(small(kept(fresh.select(F.col("doc_id").alias("met")), "fresh")), same, "left_semi")
    rows = kept(rows, "ingested")
    pages = ingest.pages(rows)
    chunks = kept((cut or ingest.chunks)(pages).select("document_id", "page_number", "chunk_index", "text"), "ingested-chunks")
    sized = rows.select("doc_id", "source", "revision", F.octet_length("text").alias("size"), F.length("text").alias("chars"))
    counts = sized.join(chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunk_count")), "doc_id", "left")
    told = counts.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    reason = F.when(F.col("chars") > ingest.MAX_TEXT_CHARS, "text_too_long").otherwise(ingest.guard_reason(F.col("size"), F.lit(1), F.col("chunk_count")))
    told = kept(told.withColumn("reason", reason), "guarded")
    told.filter("reason IS NOT NULL").select(F.col("doc_id").alias("document_id"), "revision", "reason").write.mode("overwrite").parquet(f"{rejected}/batch={batch}")
    good = told.filter("reason IS NULL").select(F.concat(F.lit("doc_"), "doc_id").alias("source"), F.col("source").alias("owner"), F.col("doc_id").alias("document_id"), "revision", "chunk_count", F.lit("indexed").alias("status"))
    refused = small(kept(told.filter("reason IS NOT NULL").select(F.col("doc_id").alias("document_id")), "refused"))
    # the refused ones are few, so texts needn't be shuffled to leave them out
    name = lambda df: df.join(refused, "document_id", "left_anti").select("document_id", F.concat(F.lit("doc_"), "document_id").alias("source"), *[c for c in df.columns if c != "document_id"])
    corpus.replace({
        "manifest": good,
        "pages": name(pages.select("document_id", "page_number", "total_pages", "raw_text", "content_hash")),
        "chunks": name(chunks),
        "stories": name(ingest.headings(pages)),
    }, stream, batch)


def ingest_stream(spark: SparkSession, source: str, schema: str, corpus: VersionedCorpus, checkpoint: str, rejected: str, stream: str = "ingest", cut: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None):
    """Document files that arrive at ``source`` become sources of a ``corpus``; all that is there now is processed, ``files`` at a time. Spark may
    deliver a batch twice after a failure, which :func:`ingest_batch` makes harmless. ``stream`` names the checkpoint in the corpus."""
    reader = spark.readStream.schema(schema)
    docs = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    take = lambda rows, batch: ingest_batch(corpus, rows, stream, batch, rejected, cut)
    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which state with timers needs."""
    key, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, own)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class _Rates(StatefulProcessor):
    """The end and count of a key's window; the state goes when the watermark passes the end."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.length = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "ends bigint, count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ends, count = self.window.get() if self.window.exists() else (0, 0)
        before = ends
        some = pd.concat(list(rows))
        some = some.assign(at=_micros(some["at"])).sort_values(["at", "event_id"])
        out = []
        for at in some["at"].tolist():
            if at >= ends:
                ends, count = at + self.length, 0
            count += 1
            out.append(count <= self.limit)
        if ends != before:
            if before:
                self.handle.deleteTimer(-(-before // 1000))
            self.handle.registerTimer(-(-ends // 1000))
        self.window.update((int(ends), int(count)))
        yield pd.DataFrame({"event_id": some["event_id"], "user_id": key[0], "allowed": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        yield pd.DataFrame({"event_id": [], "user_id": [], "allowed": []}).astype({"event_id": "int64", "user_id": "int64", "allowed": bool})

    def close(self) -> None:
        pass


def rate_stream(events: DataFrame, limit: int = 30, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """``event_id, user_id, allowed`` of a stream of events, with one window's end and count kept per user.

    A window's state goes by a timer when the watermark, ``delay`` behind the newest event, has passed its end. An event
    behind the watermark is dropped by Spark. Start the stream within :func:`rocksdb_state`.
    """
    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(_Rates(limit, seconds), "event_id bigint, user_id bigint, allowed boolean", "Append", "EventTime")


def new_revisions(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first row of each source and revision within the watermark."""
    return stream.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["source", "revision"])


def silences(stream: DataFrame, minutes: int = 5, delay: str = "5 minutes") -> DataFrame:
    """``owner, last_micros``: an owner is stale when ``minutes`` have gone by without an observation; a row for each such silence.

    Observations that follow one another within the time are a session, which ends with a silence. It is sent when the watermark, ``delay`` behind the
    newest observation of anybody, has passed the silence's end, so observations may come in any order within the delay, and batches don't matter.
    An owner that never returns gives one row and then has no state. An observation behind the watermark is dropped with the repeated ones; sessions
    by themselves would only drop it ``minutes`` later.
    """
    rows = stream.select("owner", "observed_at").withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["owner", "observed_at"])
    spells = rows.groupBy("owner", F.session_window("observed_at", f"{minutes} minutes").alias("spell")).agg(F.max("observed_at").alias("last"))
    return spells.select("owner", F.unix_micros("last").alias("last_micros"))


def freshness(stream: DataFrame, minutes: int = 5) -> DataFrame:
    """Observations per owner and window; an owner without one in the newest window is stale."""
    late = stream.withWatermark("observed_at", f"{minutes} minutes")
    return late.groupBy("owner", F.window("observed_at", f"{minutes} minutes")).agg(F.max("observed_at").alias("last"), F.count(F.lit(1)).alias("n"))

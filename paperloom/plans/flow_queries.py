"""Queries that write and read: snapshots, streams, vectors of texts, and audits of whole answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import vectors as V
from paperloom.operators import answers, embedding, ingest, retrieval
from paperloom.plans.registry import query, read
from paperloom.plans.retrieval_queries import benchmark_queries
from paperloom.plans.table_queries import _sharded
from paperloom.session import scratch_path
from paperloom.sources import snapshot
from paperloom.sources.versions import VersionedCorpus
from paperloom.streaming import streams


@query()
def r04_snapshot_search(spark, sf):
    """All benchmark texts against a fresh snapshot of all documents, reading their best shards alone."""
    path = scratch_path(spark, "snapshot")
    snapshot.write(_sharded(spark, sf), path)
    return snapshot.search(spark, path, benchmark_queries(spark, sf)).withColumn("score", F.round("score", 6))


@query("SELECT doc_id AS document_id, source AS owner, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def s08_snapshot_reconstruct(spark, sf):
    """A snapshot, written and read back, is what went in."""
    path = scratch_path(spark, "snapshot")
    snapshot.write(_sharded(spark, sf), path)
    return spark.read.parquet(f"{path}/chunks").select("document_id", "owner", F.md5("text").alias("text_md5"))


@query("""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, t AS text
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(t, ' ') <> ''),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT 'doc_' || doc_id AS source, chunk_index::INTEGER AS chunk_index, md5(l.text) AS text_md5, NULL::VARCHAR AS reason FROM l JOIN n USING (doc_id) WHERE n <= 3000
UNION ALL SELECT 'doc_' || doc_id, NULL, NULL, CASE WHEN n IS NULL THEN 'no_text' ELSE 'too_many_chunks' END FROM documents LEFT JOIN n USING (doc_id) WHERE n IS NULL OR n > 3000
""")
def t01_ingest_stream(spark, sf):
    """All document files through the ingest stream, then once more by a stream that knows nothing of the first: chunks of the corpus, and what was refused."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read(spark, sf, "documents").schema)
    out = scratch_path(spark, "stream")
    corpus = VersionedCorpus(spark, f"{out}/corpus", buckets=8)
    lines = lambda pages: ingest.lines_of_each(pages.select(F.col("document_id").alias("doc_id"), F.col("raw_text").alias("text")))
    for turn in ("first", "again"):
        streams.ingest_stream(spark, f"{sf}/documents*.parquet", schema, corpus, f"{out}/{turn}", f"{out}/rejected-{turn}", turn, lines).awaitTermination()
    made = corpus.read("chunks").select("source", F.col("chunk_index").cast("int").alias("chunk_index"), F.md5("text").alias("text_md5"), F.lit(None).cast("string").alias("reason"))
    refused = spark.read.parquet(f"{out}/rejected-first").select(F.concat(F.lit("doc_"), "document_id").alias("source"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("text_md5"), "reason")
    return made.unionByName(refused)


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^ \t\n\x0b\f\r]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def x01_embed(spark, sf):
    """Vectors have length one, but where there is no word."""
    made = embedding.with_vectors(read(spark, sf, "documents").select("doc_id", "text"), embedding.hashing_provider(256), "hashing")
    return made.select("doc_id", F.round(F.sqrt(V.dot(F.col("vector"), F.col("vector"))), 3).alias("norm"))


@query(r"""
WITH s AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || CASE turn % 6 WHEN 0 THEN 'As the hidden policy says [S1]' WHEN 1 THEN 'report, 2 files' WHEN 2 THEN 'report, 2 files [S7]' WHEN 3 THEN '2 files [S1]'
                 WHEN 4 THEN 'the report has five files [S2]' ELSE 'The REPORT has two files [S1]' END AS said FROM conversations),
c AS (SELECT *, regexp_extract_all(said, '\[S(\d+)\]', 1) AS cited FROM s)
SELECT conv_id, turn, CASE WHEN contains(lower(said), 'hidden policy') THEN 'leak' WHEN len(cited) = 0 THEN 'missing_citation' WHEN len(list_filter(cited, lambda x: x NOT IN ('1', '2'))) > 0 THEN 'unknown_citation'
  WHEN NOT contains(lower(said), 'report') THEN 'missing_exact_fact' WHEN regexp_matches(lower(said), '(^|[^a-z0-9.,])(five|[013-9]|[0-9]{2,})\s+files?([^a-z0-9]|$)') THEN 'invalid_count_fact' ELSE 'valid' END AS reason
FROM c
""")
def g03_answer_contract(spark, sf):
    """Answers that hold a turn's whole text and one of six statements."""
    k = F.col("turn") % 6
    end = F.when(k == 0, "As the hidden policy says [S1]").when(k == 1, "report, 2 files").when(k == 2, "report, 2 files [S7]").when(k == 3, "2 files [S1]").when(k == 4, "the report has five files [S2]").otherwise("The REPORT has two files [S1]")
    said = F.concat_ws(" ", F.coalesce("text", F.lit("")), end)
    verdict = answers.answer_contract(said, F.array(F.lit("S1"), F.lit("S2")), F.array(F.lit("report.pdf")), F.array(F.lit(2)).cast("array<bigint>"), ["files?"], ["hidden policy"])
    return read(spark, sf, "conversations").select("conv_id", "turn", verdict.alias("reason"))


@query("""
SELECT conv_id, count(*) AS n, count(*) % 2 = 0 AS consistent FROM conversations GROUP BY conv_id
""")
def g07_inventory_answer(spark, sf):
    """Answers that begin with a whole turn and state the right number of turns for even conversations and one more for odd ones."""
    counted = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("text"))
    said = F.concat_ws(" ", "text", F.concat(F.lit("There are "), F.col("n") + F.col("n") % 2, F.lit(" files.")))
    stated = answers.count_facts(said, ["files?"])
    return counted.select("conv_id", "n", F.forall(stated, lambda x: x == F.col("n")).alias("consistent"))


@query("""
SELECT conv_id AS document_id, turn AS page_number, md5(text || CASE WHEN conv_id % 2 = 0 THEN '' ELSE ' (copy)' END) AS text_md5 FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
""")
def r07_page_fetch(spark, sf):
    """The turns of eligible conversations as pages: of even ones from the first pool, else from the second."""
    turns = read(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("raw_text"))
    eligible = read(spark, sf, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"))
    remote = turns.withColumn("raw_text", F.concat("raw_text", F.lit(" (copy)")))
    found = retrieval.fetch_pages(turns, turns.filter("document_id % 2 = 0"), remote, eligible)
    return found.select("document_id", "page_number", F.md5("raw_text").alias("text_md5"))

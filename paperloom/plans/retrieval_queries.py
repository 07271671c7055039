"""Queries over chunks, pages and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import ingest, retrieval
from paperloom.plans import sqltext as Q
from paperloom.plans.registry import query, read
from paperloom.session import batches_of, kept, scratch_path
from paperloom.sources import snapshot


def doc_chunks(spark, sf):
    """A chunk for each document that has text."""
    docs = read(spark, sf, "documents").filter("text <> ''")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")


def benchmark_queries(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


BM25_SQL = f"""
c AS (SELECT doc_id AS chunk_id, {Q.tokens('text')} AS w FROM documents WHERE text <> ''),
stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM c),
q AS (SELECT DISTINCT item_id AS query_id, unnest({Q.tokens('text')}) AS token FROM benchmark),
p AS (SELECT token, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS token FROM c) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
lex AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 9) AS lexical
        FROM q JOIN p USING (token) JOIN df USING (token), stat GROUP BY query_id, chunk_id)
"""


@query(f"""
WITH {BM25_SQL}
SELECT query_id, chunk_id, round(round(lexical, 9), 4) AS lexical, rank::INTEGER AS rank, 'S' || rank AS citation_id
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, chunk_id) AS rank FROM lex) WHERE rank <= 5
""")
def r01_lexical_search(spark, sf):
    scored = retrieval.lexical_scores(doc_chunks(spark, sf), benchmark_queries(spark, sf), k=5)
    return retrieval.cite(retrieval.top_k(scored, "lexical", 5)).withColumn("lexical", F.round("lexical", 4))


#: As above, with words within one edit. DuckDB counts edits of bytes, so letters beyond ASCII are given one byte each.
TOLERANT_SQL = BM25_SQL.replace("lex AS (", "v AS (SELECT DISTINCT token FROM p), qt AS (SELECT DISTINCT query_id, v.token FROM q JOIN v ON v.token = q.token OR (NOT regexp_full_match(q.token, '[0-9]{1,4}') AND abs(length(v.token) - length(q.token)) <= 1 AND levenshtein(translate(v.token, 'ßæœøđłþðı', 'ABCDEFGHI'), translate(q.token, 'ßæœøđłþðı', 'ABCDEFGHI')) <= 1)), lex AS (").replace("FROM q JOIN p USING (token) JOIN df", "FROM qt JOIN p USING (token) JOIN df")


@query(f"""
WITH {TOLERANT_SQL}
SELECT query_id, chunk_id, round(lexical, 4) AS lexical, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rank FROM lex) WHERE rank <= 16
""")
def r01_tolerant_search(spark, sf):
    """As r01, with words within one edit; numbers stay exact."""
    scored = retrieval.lexical_scores(doc_chunks(spark, sf), benchmark_queries(spark, sf), tolerance=1, k=16)
    return retrieval.top_k(scored, "lexical", 16).withColumn("lexical", F.round("lexical", 4))


_CONTAINS_SQL = f"""
SELECT item_id AS query_id, doc_id AS chunk_id
FROM (SELECT item_id, {Q.norm('text')} AS needle FROM benchmark) JOIN (SELECT doc_id, {Q.norm('text')} AS body FROM documents WHERE text <> '')
ON needle <> '' AND contains(body, needle)
"""


@query(f"SELECT query_id, min(chunk_id) AS document_id, 1 AS page_number FROM ({_CONTAINS_SQL}) GROUP BY query_id")
def j06_exact_quote(spark, sf):
    return retrieval.exact_quotes(ingest.pages(read(spark, sf, "documents")), benchmark_queries(spark, sf))


def _documents_as_chunks(spark, sf):
    docs = read(spark, sf, "documents").filter("text <> ''")
    return docs.select(F.col("source").alias("owner"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.lit(1).alias("page_number"), "text")


def written_snapshot(spark, sf):
    """All documents as a fresh snapshot."""
    path = scratch_path(spark, "snapshot")
    snapshot.write(snapshot.assign_shards(_documents_as_chunks(spark, sf), snapshot.LEAST_BYTES), path)
    return path


@query()
def r06_quote_lookup(spark, sf):
    """Benchmark texts as they are and misquoted (every seventh word another) in two thirds of the documents, then in a snapshot of all."""
    asked = benchmark_queries(spark, sf)
    other = F.array_join(F.transform(F.split("query", " "), lambda w, i: F.when(i % 7 == 3, F.lit("misquoted")).otherwise(w)), " ")
    quotes = asked.unionByName(asked.select((-1 - F.col("query_id")).alias("query_id"), other.alias("query")))
    local = ingest.pages(read(spark, sf, "documents").filter("doc_id % 3 <> 0"))
    found = retrieval.quote_lookup(local, quotes, snapshot.SnapshotProvider(spark, written_snapshot(spark, sf)))
    return found.withColumn("score", F.round("score", 6))


_COSINE_SQL = """
cos AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine
        FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0)
"""


@query(f"""
WITH {_COSINE_SQL}
SELECT query_id, chunk_id, round(round(cosine, 9), 6) AS cosine, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) AS rank FROM cos) WHERE rank <= 8
""")
def j08_vector_search(spark, sf):
    e = read(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("provider"))
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("provider"))
    scored = retrieval.semantic_scores(vectors, asked, k=8).withColumn("cosine", F.round("cosine", 9))
    return retrieval.top_k(scored, "cosine", 8).withColumn("cosine", F.round("cosine", 6))


_HYBRID_SQL = f"""
{TOLERANT_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rank FROM lex),
top AS (SELECT query_id, chunk_id, 0.36 * lexical / greatest(1.0, max(lexical) OVER (PARTITION BY query_id)) + 0.12 / rank AS part, 1 AS l, 0 AS s FROM ranked WHERE rank <= 16),
cos AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, 0.46 * greatest(0.0, (list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) - 0.2) / 0.8) AS part, 0 AS l, 1 AS s
        FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings v ON q.label = v.label JOIN documents d ON d.doc_id = v.vec_id AND d.text <> ''),
qn AS (SELECT query_id, token, count(*) AS n FROM (SELECT item_id AS query_id, unnest({Q.tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
cov AS (SELECT query_id, chunk_id, 0.2 * sum(n) / any_value(total) AS part, 0 AS l, 0 AS s
        FROM qn JOIN p USING (token) JOIN (SELECT query_id, sum(n) AS total FROM qn GROUP BY query_id) USING (query_id) GROUP BY query_id, chunk_id),
ex AS (SELECT query_id, chunk_id, 0.85 AS part, 0 AS l, 0 AS s FROM ({_CONTAINS_SQL})),
names AS (SELECT doc_id AS chunk_id, {Q.norm("array_to_string(list_slice(string_split(text, ' '), 2, 5), ' ')")} AS title FROM documents WHERE text <> '' UNION SELECT doc_id, {Q.norm('source')} FROM documents WHERE text <> ''),
named AS (SELECT DISTINCT item_id AS query_id, chunk_id, 0.22 AS part, 0 AS l, 0 AS s FROM names JOIN (SELECT item_id, {Q.norm('text')} AS q FROM benchmark) ON title <> '' AND contains(q, title)),
scored AS (SELECT query_id, chunk_id, sum(part) AS score, CASE WHEN max(l) = 1 AND max(s) = 1 THEN 'hybrid' WHEN max(s) = 1 THEN 'semantic' ELSE 'lexical' END AS method
           FROM (SELECT * FROM top UNION ALL SELECT * FROM cos UNION ALL SELECT * FROM cov UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM named) GROUP BY query_id, chunk_id HAVING sum(part) > 0.03)
"""


def _hybrid(spark, sf, **options):
    e = read(spark, sf, "embeddings")
    chunks, asked = doc_chunks(spark, sf), benchmark_queries(spark, sf)
    vectors = e.join(chunks.select("chunk_id"), F.col("vec_id") == F.col("chunk_id")).select("chunk_id", F.col("embedding").alias("vector"), F.col("label").alias("provider"))
    query_vectors = e.join(asked.select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"), F.col("label").alias("provider"))
    docs = read(spark, sf, "documents").filter("text <> ''")
    line = F.array_join(F.slice(F.split("text", " "), 2, 4), " ")  # four words of the text as a title, the source's name as an alias
    titles = docs.select(F.col("doc_id").alias("document_id"), line.alias("title")).union(docs.select("doc_id", "source"))
    return retrieval.hybrid_scores(chunks, asked, retrieval.semantic_scores(vectors, query_vectors), titles, **options), chunks


@query(f"""
WITH {_HYBRID_SQL}
SELECT query_id, chunk_id, round(round(score, 9), 6) AS score, method, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored) WHERE rank <= 8
""")
def r02_hybrid_score(spark, sf):
    scored, _ = _hybrid(spark, sf, k=8)
    ranked = retrieval.top_k(scored.withColumn("score", F.round("score", 9)), "score", 8)
    return ranked.withColumn("score", F.round("score", 6))


@query()
def w01_diverse_selection(spark, sf):
    scored, chunks = _hybrid(spark, sf, least=retrieval.SELECT_FLOOR)
    return retrieval.select_diverse(scored, chunks).withColumn("score", F.round("score", 6))


@query(f"""
WITH {BM25_SQL.replace("FROM documents WHERE text <> ''", "FROM documents WHERE text <> '' AND doc_id % 2 = 0")},
h AS (SELECT doc_id AS chunk_id, '0x' || sha256(text) AS content_hash FROM documents),
near AS (SELECT query_id, chunk_id, lexical / 100 AS score FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) <= 16),
qn AS (SELECT query_id, token, count(*) AS n FROM (SELECT item_id AS query_id, unnest({Q.tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
w AS (SELECT DISTINCT doc_id AS chunk_id, unnest({Q.tokens('text')}) AS token FROM documents WHERE text <> ''),
part AS (SELECT query_id, chunk_id, 0.42 * sum(n) / any_value(total) AS score FROM qn JOIN w USING (token) JOIN (SELECT query_id, sum(n) AS total FROM qn GROUP BY query_id) USING (query_id) GROUP BY query_id, chunk_id
         UNION ALL SELECT query_id, chunk_id, 0.85 FROM ({_CONTAINS_SQL})),
met AS (SELECT query_id, chunk_id, round(sum(score), 9) AS score FROM part GROUP BY ALL HAVING round(sum(score), 9) >= 0.12),
far AS (SELECT * FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 8) WHERE chunk_id % 2 <> 0),
best AS (SELECT query_id, chunk_id, content_hash, score FROM (SELECT * FROM near UNION ALL SELECT * FROM far) JOIN h USING (chunk_id)
         QUALIFY row_number() OVER (PARTITION BY query_id, content_hash ORDER BY score DESC, chunk_id) = 1)
SELECT query_id, chunk_id, round(score, 4) AS score, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best) WHERE rank <= 8
""")
def u01_r05_merged_search(spark, sf):
    """Even documents are served locally, by words; a snapshot of all documents is searched beside them, and gives the odd ones."""
    asked = benchmark_queries(spark, sf)
    served = doc_chunks(spark, sf).filter("chunk_id % 2 = 0")
    every = doc_chunks(spark, sf).withColumn("content_hash", T.content_hash(F.col("text")))
    tell = lambda scored: every.join(scored.select("query_id", "chunk_id", "score"), "chunk_id").select("query_id", "chunk_id", "document_id", "page_number", "content_hash", "text", "score")
    lexical = retrieval.lexical_scores(served, asked, k=16).withColumn("score", F.col("lexical") / 100)
    local = tell(retrieval.top_k(lexical, "score", 16))
    merged = retrieval.merged_search(local, lambda: tell(snapshot.search(spark, written_snapshot(spark, sf), asked, exhaustive=True)), served, required=True)
    return merged.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query(f"""
WITH {BM25_SQL},
top AS (SELECT query_id, chunk_id FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, chunk_id) = 1),
held AS (SELECT DISTINCT query_id FROM ({_CONTAINS_SQL})),
good AS (SELECT DISTINCT query_id FROM top JOIN ({_CONTAINS_SQL}) USING (query_id, chunk_id))
SELECT count(*) AS n_labelled, count(good.query_id) AS n_hits, round(count(good.query_id) / count(*), 6) AS top1_rate FROM held LEFT JOIN good USING (query_id)
""")
def r08_relevance(spark, sf):
    """Of the quotes that some document holds, the share whose best lexical hit holds it."""
    chunks, asked = doc_chunks(spark, sf), benchmark_queries(spark, sf)
    tokens = retrieval.prepared(chunks)
    with batches_of(spark):
        scored = retrieval.lexical_scores(chunks, asked, tokens=tokens, k=1)
        top = kept(retrieval.top_k(scored, "lexical", 1).select("query_id", "chunk_id"), "top")
        holds = kept(retrieval.contains_pairs(chunks, asked, tokens), "holds")
    hit = top.join(holds, ["query_id", "chunk_id"]).select("query_id", F.lit(1).alias("hit"))
    held = holds.select("query_id").distinct().join(hit, "query_id", "left")
    return held.agg(F.count(F.lit(1)).alias("n_labelled"), F.count("hit").alias("n_hits"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("top1_rate"))


@query("""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, t AS text
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(t, ' ') <> '')
SELECT doc_id AS document_id, chunk_index::INTEGER AS chunk_index, md5(text) AS text_md5 FROM l
""")
def w07_chunk_ids(spark, sf):
    return ingest.paragraph_chunks(read(spark, sf, "documents")).select("document_id", "chunk_index", F.md5("text").alias("text_md5"))


@query("""
WITH c AS (SELECT doc_id, count(*) AS chunk_count FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE trim(t, ' ') <> '' GROUP BY doc_id)
SELECT doc_id AS document_id, 1::BIGINT AS page_count, CASE WHEN length(trim(text, ' ')) >= 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS text_coverage, coalesce(chunk_count, 0) AS chunk_count
FROM documents LEFT JOIN c USING (doc_id)
""")
def a03_manifest_stats(spark, sf):
    docs = read(spark, sf, "documents")
    return ingest.manifest_stats(ingest.pages(docs), ingest.paragraph_chunks(docs))

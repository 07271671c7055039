"""Queries over workspaces: access records, routes, registered names, books, estimates, deletions, packages, receipts, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import access
from paperloom.functions import text as T
from paperloom.operators import answers, canonical, ingest, retrieval, workspace
from paperloom.plans import sqltext as Q
from paperloom.plans.registry import SQL, query, read
from paperloom.plans.retrieval_queries import _CONTAINS_SQL, BM25_SQL, benchmark_queries, doc_chunks
from paperloom.plans.table_queries import _SHARD_SQL, _sharded
from paperloom.session import batches_of, kept, scratch_path
from paperloom.sources import inventory, snapshot
from paperloom.streaming import streams


@query()
def s01_file_inventory(spark, sf):
    """The stored files of the documents table, as listed."""
    return inventory.file_inventory(spark, f"{sf}/documents.parquet").select("name", "size", "created_micros")


_RECORD = {
    0: "'{\"accessPolicy\":{\"type\":\"timelock\",\"lockedUntilMicros\":' || (1700000000000000 + c_custkey) || ',\"canAccess\":true,\"greenBoxByteLength\":8}}'",
    1: "'{\"accessPolicy\":{\"type\":\"custom\"},\"tag\":\"paid\"}'",
    2: "'{\"tag\":\" Time-Locked\",\"unlockAt\":\"' || (1600000000 + c_custkey) || '\",\"name\":\"' || c_name || '\"}'",
    3: "'{\"metadata\":{\"accessTag\":\"Allow list\",\"allowlist\":[\"' || c_name || '\",\" 0xA \",\"\"]},\"allowlist\":\"0xa, 0xB,\"}'",
    4: "'{\"access\":{\"tag\":\"purchase\",\"purchasedBy\":[\"' || c_name || '\"],\"timeLock\":{\"unlockTime\":' || (1700000000000 + c_custkey) || '}}}'",
    5: "'{\"tags\":[\"allowlist\",\"' || c_name || '\"],\"accessControl\":{\"addresses\":\"' || c_name || '\"}}'",
    6: "'{\"name\":\"' || c_name || '\"}'",
}
_RECORD_SQL = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RECORD.items()) + " END"


@query("""
SELECT c_custkey,
       CASE c_custkey % 7 WHEN 0 THEN 'time_lock' WHEN 2 THEN 'time_lock' WHEN 3 THEN 'allowlist' WHEN 4 THEN 'purchasable' WHEN 5 THEN 'allowlist' ELSE 'public' END AS tag,
       CASE c_custkey % 7 WHEN 0 THEN 1700000000000000 + c_custkey WHEN 2 THEN (1600000000 + c_custkey) * 1000000 WHEN 4 THEN (1700000000000 + c_custkey) * 1000 END::BIGINT AS unlock_at_micros,
       CASE c_custkey % 7 WHEN 3 THEN '0xa,0xb,' || lower(c_name) WHEN 5 THEN lower(c_name) ELSE '' END AS allowlist,
       CASE WHEN c_custkey % 7 = 4 THEN lower(c_name) ELSE '' END AS purchasers,
       c_custkey % 7 = 0 AS requires_decryption, c_custkey % 7 IN (0, 1) AS on_chain, c_custkey % 7 = 1 AS unresolved
FROM customer
""")
def p16_access_info(spark, sf):
    """Records of seven shapes; the SQL states what each decodes to."""
    told = access.with_access_info(read(spark, sf, "customer").select("c_custkey", F.expr(_RECORD_SQL).alias("record")), "record").select("c_custkey", F.col("access_info").alias("a"))
    return told.select(
        "c_custkey", "a.tag", "a.unlock_at_micros", F.array_join(F.array_sort("a.allowlist"), ",").alias("allowlist"), F.array_join("a.purchasers", ",").alias("purchasers"),
        "a.requires_decryption", "a.on_chain", "a.unresolved",
    )


SCOPE_WORDS = {"english": "the|and", "german": "der|und", "french": "les|des", "spanish": "los|que"}
_SCOPE_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({p})($|[^\\p{{L}}\\p{{N}}_])') THEN '{n}' END" for n, p in SCOPE_WORDS.items())


@query(f"""
WITH m AS (SELECT conv_id, turn, list_filter([{_SCOPE_SQL}], lambda x: x IS NOT NULL) AS named FROM conversations)
SELECT conv_id, turn, array_to_string(named, ',') AS scopes, len(named) > 0 AND NOT list_contains(named, 'english') AS mismatch FROM m
""")
def p24_scope_mentions(spark, sf):
    """Which languages' words a turn holds, and whether those of the active scope are missing."""
    named = read(spark, sf, "conversations").select("conv_id", "turn", access.mentioned_scopes(F.col("text"), SCOPE_WORDS).alias("named"))
    return named.select("conv_id", "turn", F.array_join("named", ",").alias("scopes"), access.scope_mismatch(F.col("named"), F.lit("english")).alias("mismatch"))


@query("SELECT doc_id AS document_id, 'text_too_long' AS reason FROM documents WHERE length(text) > 5000")
def f07_rejected_texts(spark, sf):
    """Texts over the limit of a small upload, with the reason."""
    return ingest.rejected(read(spark, sf, "documents"), longest=5000)


LEAK_MARKS = ["License", "password", "@example", "secret"]


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{m.lower()}')" for m in LEAK_MARKS) + " AS leaks FROM documents")
def p26_leak_marks(spark, sf):
    return read(spark, sf, "documents").select("doc_id", access.holds_any(F.col("text"), LEAK_MARKS).alias("leaks"))


@query(f"""
WITH n AS (SELECT doc_id, text, trim(substr(text, 1 + length(text) // 2, 40), ' ') AS needle FROM documents)
SELECT doc_id, instr(text, needle) AS position, length(needle) AS n, md5(substr(text, 1, instr(text, needle) - 1)) AS before_md5, md5(substr(text, instr(text, needle) + length(needle))) AS after_md5
FROM n WHERE needle <> ''
""")
def p29_highlight_spans(spark, sf):
    """Where the words in the middle of each text first stand."""
    needle = F.trim(F.substring("text", 1 + F.floor(F.length("text") / 2).cast("int"), F.lit(40)))
    spans = read(spark, sf, "documents").select("doc_id", access.highlight(F.col("text"), needle).alias("h")).filter("h IS NOT NULL")
    return spans.select("doc_id", (F.length("h.before") + 1).alias("position"), F.length("h.match").alias("n"), F.md5("h.before").alias("before_md5"), F.md5("h.after").alias("after_md5"))


@query(f"""
WITH c AS (SELECT doc_id, text AS own, CASE WHEN doc_id % 4 = 0 THEN '[Image]' || chr(10) || 'ai DESCRIPTION:  ' || text ELSE text END AS text FROM documents
           WHERE doc_id % 3 <> 0 AND NOT regexp_matches(lower(text), '(ai description|mô tả ai):')),
u AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN '[Image]' || chr(10) || 'File name: img_' || doc_id || '.png' || chr(10) || chr(10) || 'AI description: ' || 'seen ' || doc_id ELSE text END AS said FROM c)
SELECT doc_id, md5(said) AS text_md5, CASE WHEN doc_id % 5 = 0 THEN '0x' || sha256({Q.norm('said')}) ELSE 'old' END AS content_hash, doc_id % 5 <> 0 AS has_vector,
       md5(coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN 'seen ' || doc_id WHEN doc_id % 4 = 0 THEN regexp_replace(regexp_replace(own, '^[ \t\n\x0b\f\r]+', ''), '[ \t\n\x0b\f\r]+$', '') ELSE '' END, ''), '-')) AS description_md5
FROM u
""")
def p30_image_descriptions(spark, sf):
    """Chunks of images: some have a description in their text, some get a new one."""
    docs = read(spark, sf, "documents").filter("doc_id % 3 <> 0").filter(~F.lower("text").rlike("(ai description|mô tả ai):"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("[Image]\nai DESCRIPTION:  "), "text")).otherwise(F.col("text"))
    chunks = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("img_"), "doc_id", F.lit(".png")).alias("name"), text.alias("text"), F.lit("old").alias("content_hash"), F.array(F.lit(1.0)).alias("vector"))
    fresh = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("document_id"), F.concat(F.lit(" seen "), "doc_id").alias("description"))
    out = workspace.describe_images(chunks, fresh)
    said = F.coalesce(workspace.image_description(F.col("text")), F.lit("-"))
    return out.select(F.col("document_id").alias("doc_id"), F.md5("text").alias("text_md5"), "content_hash", F.col("vector").isNotNull().alias("has_vector"), F.md5(said).alias("description_md5"))


_ROUTE_SQL = "'{\"scope\":\"' || CASE turn % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'tool' WHEN 3 THEN role ELSE 'general' END || '\",\"referencedSources\":[\"' || role || '\",\"invented\",\"' || role || '\"],\"imageAction\":\"show\",\"confidence\":' || CASE WHEN turn % 2 = 0 THEN '1.5' ELSE '0.25' END || '}'"


@query("""
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'tool' ELSE 'general' END AS scope,
       CASE WHEN turn % 5 <= 1 AND role IN ('user', 'assistant') THEN role ELSE '' END AS sources, CASE WHEN turn % 5 = 1 THEN 'show' END AS image_action,
       CASE WHEN turn % 5 = 3 THEN 0.0 WHEN turn % 2 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence
FROM conversations
""")
def g08_routes(spark, sf):
    """Routes with unknown scopes, invented and repeated sources and a confidence out of range."""
    route = access.normalize_route(F.expr(_ROUTE_SQL), F.array(F.lit("user"), F.lit("assistant")))
    told = read(spark, sf, "conversations").select("conv_id", "turn", route.alias("r"))
    return told.select("conv_id", "turn", "r.scope", F.array_join("r.referenced_sources", ",").alias("sources"), "r.image_action", "r.confidence")


@query("""
SELECT o_custkey AS account, o_orderkey AS name, max(l_suppkey) AS uid, max(l_suppkey) IS NULL AS missing
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_suppkey % 3 <> 0 GROUP BY o_custkey, o_orderkey
""")
def j09_registered_names(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("name"))
    lines = read(spark, sf, "lineitem").filter("l_linenumber = 1 AND l_suppkey % 3 <> 0").join(orders.withColumnRenamed("name", "l_orderkey"), "l_orderkey")
    registered = lines.select(workspace.object_name(F.col("account"), F.col("l_orderkey")).alias("object_name"), F.col("l_suppkey").alias("uid"))
    return workspace.resolve_registered(orders, registered).select("account", "name", "uid", "missing")


@query("""
SELECT p_partkey || '.PDF' AS name, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS aliases,
       CASE WHEN p_partkey % 3 = 0 THEN p_size END::BIGINT AS pages, p_partkey % 3 = 0 AND p_partkey % 10 >= 7 AS confirmed
FROM part WHERE p_partkey % 2 = 0
""")
def j10_books(spark, sf):
    part = read(spark, sf, "part")
    name = F.concat("p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise(".pdf.txt"))
    told = part.filter("p_partkey % 3 = 0").select(name.alias("source"), F.col("p_name").alias("title"), F.array("p_brand").alias("aliases"), F.col("p_size").cast("bigint").alias("pages"), ((F.col("p_partkey") % 10) / 10).alias("confidence"))
    return workspace.book_inventory(part.select(name.alias("name")), told).withColumn("aliases", F.array_join("aliases", ","))


@query(f"""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, t AS text
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(t, ' ') <> ''),
f AS (SELECT query_id, min(chunk_id) AS document_id FROM ({_CONTAINS_SQL}) GROUP BY query_id),
m AS (SELECT query_id, document_id, chunk_index, contains({Q.norm('l.text')}, {Q.norm('b.text')}) AS holds, {Q.tokens('b.text')} AS q, {Q.tokens('l.text')} AS w
      FROM f JOIN l ON l.doc_id = document_id JOIN benchmark b ON b.item_id = query_id),
s AS (SELECT *, round(CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: list_contains(w, x))) / len(q) ELSE 0 END, 9) AS cover FROM m)
SELECT query_id, document_id, 1 AS page_number, chunk_index::INTEGER AS chunk_index, holds FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY holds DESC, cover DESC, chunk_index) = 1
""")
def j12_quote_chunks(spark, sf):
    docs, quotes = read(spark, sf, "documents"), benchmark_queries(spark, sf)
    with batches_of(spark):
        found = kept(retrieval.exact_quotes(ingest.pages(docs), quotes), "found")
    met = docs.join(retrieval.small(found.select(F.col("document_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    return retrieval.best_chunks(found, ingest.paragraph_chunks(met), quotes)


@query(f"""
WITH {BM25_SQL},
qn AS (SELECT query_id, token, count(*) AS n FROM (SELECT item_id AS query_id, unnest({Q.tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
cov AS (SELECT query_id, chunk_id, 0.42 * sum(n) / any_value(total) AS part, 1 AS l, 0 AS s
        FROM qn JOIN p USING (token) JOIN (SELECT query_id, sum(n) AS total FROM qn GROUP BY query_id) USING (query_id) GROUP BY query_id, chunk_id),
ex AS (SELECT query_id, chunk_id, 0.85 AS part, 1 AS l, 0 AS s FROM ({_CONTAINS_SQL})),
cos AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, 0.5 * greatest(0.0, (list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) - 0.2) / 0.8) AS part, 0 AS l, 1 AS s
        FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings v ON q.label = v.label JOIN documents d ON d.doc_id = v.vec_id AND d.text <> ''),
scored AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score, CASE WHEN max(l) = 1 AND max(s) = 1 THEN 'hybrid' WHEN max(s) = 1 THEN 'semantic' ELSE 'lexical' END AS method
           FROM (SELECT * FROM cov UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM cos) GROUP BY query_id, chunk_id HAVING round(sum(part), 9) >= 0.12)
SELECT query_id, chunk_id, round(score, 6) AS score, method, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 8
""")
def r03_package_score(spark, sf):
    chunks, asked = doc_chunks(spark, sf), benchmark_queries(spark, sf)
    e = read(spark, sf, "embeddings")
    vectors = e.join(chunks.select("chunk_id"), F.col("vec_id") == F.col("chunk_id")).select("chunk_id", F.col("embedding").alias("vector"), F.col("label").alias("provider"))
    told = e.join(asked.select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"), F.col("label").alias("provider"))
    scored = retrieval.package_scores(chunks, asked, retrieval.semantic_scores(vectors, told))
    return retrieval.top_k(scored, "score", 8).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS documents, count(*) AS pages, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text <> ''")
def a04_snapshot_totals(spark, sf):
    return snapshot.totals(_sharded(spark, sf))


@query("""
WITH n AS (SELECT label, vec_id % 3 AS provider, count(*) AS n FROM embeddings GROUP BY label, vec_id % 3),
g AS (SELECT label, provider FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, provider) = 1),
x AS (SELECT g.label, g.provider, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings e JOIN g ON g.label = e.label AND g.provider = e.vec_id % 3),
m AS (SELECT label, provider, pos, round(avg(x), 9) AS x FROM x GROUP BY ALL),
u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS u FROM m),
q AS (SELECT *, greatest(max(abs(u)) OVER (PARTITION BY label), 0.000001) / 127 AS scale FROM u)
SELECT label AS shard_id, 'p' || provider AS provider, count(*)::INTEGER AS dimensions, string_agg(greatest(1, least(255, floor(u / scale + 0.5)::INTEGER + 128))::VARCHAR, ',' ORDER BY pos) AS codes FROM q GROUP BY label, provider
""")
def a06_centroids(spark, sf):
    rows = read(spark, sf, "embeddings").select(F.col("label").alias("shard_id"), F.concat(F.lit("p"), F.col("vec_id") % 3).alias("provider"), F.col("embedding").alias("vector"))
    return snapshot.centroids(rows).select("shard_id", "provider", "dimensions", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query("""
WITH i AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' WHEN 3 THEN '.txt' ELSE '.Pdf' END AS ext, strlen(text) AS size,
                  CASE WHEN doc_id % 5 = 0 THEN 1 + doc_id % 9 END AS pages, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 11) / 10.0 END AS covered, CASE WHEN doc_id % 7 = 0 THEN doc_id END AS chunks FROM documents)
SELECT sum(CASE WHEN ext IN ('.PNG', '.mp4') THEN 1 WHEN pages > 0 THEN greatest(1, ceil(pages * (1 - least(1.0, coalesce(covered, 0.85))::DOUBLE))) WHEN lower(ext) = '.pdf' THEN 1 ELSE 0 END)::BIGINT AS content_calls,
       bool_or(ext = '.Pdf') AS uncertain,
       sum(CASE WHEN ext = '.PNG' THEN 0 ELSE ceil(least(3000, CASE WHEN chunks > 0 THEN chunks WHEN ext = '.mp4' THEN 1 ELSE greatest(1, ceil(greatest(1, coalesce(size, 1200)) / 3600.0)) END) / 20.0) END)::BIGINT AS vector_calls,
       bool_or(ext = '.mp4') AS has_video
FROM i
""")
def a09_call_estimate(spark, sf):
    k = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".mp4", ".txt", ".Pdf"])), (k % 5 + 1).cast("int"))
    items = read(spark, sf, "documents").select(
        F.concat(k, ext).alias("name"), F.octet_length("text").alias("size"), F.when(k % 5 == 0, 1 + k % 9).alias("page_count"), F.when(k % 2 == 0, (k % 11) / 10).alias("text_coverage"), F.when(k % 7 == 0, k).alias("chunks"),
    )
    return workspace.call_estimate(items)


@query("""
SELECT c_nationkey AS owner, sum(strlen('{"key":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}'))::BIGINT AS bytes FROM customer GROUP BY c_nationkey
""")
def a10_storage_bytes(spark, sf):
    rows = read(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return workspace.storage_bytes(rows, "c_nationkey")


@query("""
SELECT o_orderkey AS name, o_custkey AS owner, o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS verified FROM orders
""")
def m04_mark_unverified(spark, sf):
    listed = read(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("owner"), (F.col("o_orderstatus") != "P").alias("verified"))
    return workspace.mark_unverified(listed, read(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("owner")))


@query("""
SELECT doc_id, source FROM documents WHERE NOT (source IN (SELECT min(source) FROM documents)) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.toxic = 1)
""")
def m06_delete(spark, sf):
    """All rows of one workspace go, and the toxic sources of the others."""
    rows = read(spark, sf, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("source"), "text")
    toxic = rows.join(read(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("source")), "source", "left_semi")
    left = workspace.delete_sources(rows, toxic.select("owner", "source"))
    left = workspace.delete_sources(left, rows.agg(F.min("owner").alias("owner")), ("owner",))
    return left.select(F.col("source").alias("doc_id"), F.col("owner").alias("source"))


@query("""
WITH t AS (SELECT conv_id, turn, role, text, coalesce(nullif(trim(text, ' '), ''), '-') AS said FROM conversations),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
SELECT conv_id AS receipt_id, 'pass' AS schema, CASE WHEN conv_id % 7 = 1 THEN 'fail' ELSE 'pass' END AS receipt_id_check, CASE WHEN conv_id % 7 = 2 THEN 'fail' ELSE 'pass' END AS envelope_digest,
       CASE WHEN conv_id % 7 IN (3, 4) THEN 'fail' ELSE 'pass' END AS citations, CASE WHEN conv_id % 7 IN (4, 5) THEN 'fail' ELSE 'pass' END AS excerpt_hashes,
       CASE WHEN conv_id % 7 = 4 THEN 'fail' ELSE 'declared_only' END AS declared_hashes, CASE WHEN conv_id % 7 IN (4, 6) THEN 'fail' ELSE 'pass' END AS evidence_scope,
       conv_id % 7 = 0 AS valid
FROM n
""")
def g05_receipt_audit(spark, sf):
    """A receipt for each conversation, whose turns are its sources; six of seven are tampered with, each in its way."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("conv_id") % 7
    sources = turns.select(
        F.col("conv_id").alias("receipt_id"), F.concat(F.lit("S"), F.col("turn") + 1).alias("citation_id"), F.concat(F.lit("turn "), "turn").alias("source"), F.col("turn").alias("page_number"), F.col("text").alias("excerpt"),
        F.lit("source_verified").alias("level"), F.lit("text_layer").alias("method"), *[F.lit(None).cast("string").alias(c) for c in ("indexed_root", "current_root", "recomputed_root", "chunk_hash")],
        F.sha2("text", 256).alias("page_hash"),
    )
    kept = answers.citation_integrity(F.col("citation_id"), F.col("source"), F.col("page_number"), F.col("excerpt"))
    tampered = F.col("receipt_id") % 7
    records = sources.filter("receipt_id % 7 <> 4 OR page_number > 0").select(
        "receipt_id", "citation_id", "source", "page_number", F.lit(answers.EXCERPT_FORM).alias("excerpt_form"),
        F.when(tampered == 5, F.sha2("source", 256)).otherwise(kept["excerpt_sha256"]).alias("excerpt_sha256"), kept["citation_sha256"].alias("citation_sha256"),
        F.col("page_hash").alias("page_sha256"), F.lit(None).cast("string").alias("chunk_sha256"),
        F.when(tampered == 6, "index_record_only").otherwise("source_bytes_verified_at_creation").alias("scope"), "method",
    )
    cites = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    answer = F.concat(F.lit("as said "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("last") + F.when(k == 3, 2).otherwise(1)), lambda i: F.concat(F.lit("[S"), i.cast("string"), F.lit("]"))), " "))
    receipts = cites.select(F.col("conv_id").alias("receipt_id"), answer.alias("answer"))
    # the id is that of the record's canonical form; the record itself comes with its keys in another order and with white space
    record = F.concat(F.lit('{ "receiptId": '), "receipt_id", F.lit(', "answer" : '), canonical.quoted(F.col("answer")), F.lit(', "checks": [1.0, {"b": -0.0, "a": []}] }'))
    declared = F.concat(F.lit('{"answer":'), canonical.quoted(F.col("answer")), F.lit(',"checks":[1,{"a":[],"b":0}],"receiptId":'), "receipt_id", F.lit("}"))
    receipts = receipts.withColumn("record", record).withColumn("declared", declared)
    bodies = canonical.canonical_json(receipts, "receipt_id", "record").withColumnRenamed("canonical", "body")
    receipts = receipts.join(bodies, "receipt_id").withColumn("payload", F.concat_ws("|", F.lit("p"), "body"))
    receipts = receipts.withColumn("declared_id", F.sha2(F.concat("declared", F.when(tampered == 1, "x").otherwise("")), 256)).withColumn("digest", F.concat(F.lit("0x"), F.sha2(F.concat("payload", F.when(tampered == 2, "x").otherwise("")), 256)))
    return answers.receipt_audit(receipts, sources, records).drop("n_errors")


def _written(spark, sf):
    path = scratch_path(spark, "snapshot")
    snapshot.write(_sharded(spark, sf), path)
    return path


@query("SELECT doc_id AS document_id, source AS owner, 1::BIGINT AS pages, 1::BIGINT AS chunks FROM documents WHERE text <> ''")
def s07_snapshot_catalog(spark, sf):
    return snapshot.catalog(spark, _written(spark, sf))


@query(f"""
WITH RECURSIVE {_SHARD_SQL}
SELECT source || ':' || lpad(shard::VARCHAR, 8, '0') AS shard_id, count(*) AS chunk_count, sum(bytes)::BIGINT AS byte_length, NULL::VARCHAR AS fault FROM g GROUP BY source, shard
""")
def x03_shard_loader(spark, sf):
    """Every shard, loaded and checked against the manifest."""
    path = _written(spark, sf)
    loaded = snapshot.load_shards(spark, path).groupBy("shard_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.octet_length("text")).cast("bigint").alias("byte_length"))
    return loaded.join(snapshot.shard_faults(spark, path), "shard_id", "left")


@query(f"SELECT query_id, min(chunk_id) AS document_id, 1 AS page_number FROM ({_CONTAINS_SQL}) GROUP BY query_id")
def x02_snapshot_quotes(spark, sf):
    """Quotes looked up through a snapshot alone."""
    return snapshot.SnapshotProvider(spark, _written(spark, sf)).lookup_quotes(benchmark_queries(spark, sf))


@query(f"""
WITH RECURSIVE {_SHARD_SQL},
c AS (SELECT source, shard, token, count(*) AS n FROM (SELECT g.source, shard, unnest({Q.tokens('text', Q.SHARD_STOPS)}) AS token FROM g JOIN documents USING (doc_id)) GROUP BY source, shard, token),
t AS (SELECT source || ':' || lpad(shard::VARCHAR, 8, '0') AS shard_id, token FROM c QUALIFY row_number() OVER (PARTITION BY source, shard ORDER BY n DESC, token) <= 96),
q AS (SELECT item_id AS query_id, unnest({Q.tokens('text', Q.SHARD_STOPS)}) AS token FROM benchmark),
s AS (SELECT query_id, shard_id, round(0.72 * count(*) / any_value(total), 9) AS score FROM q JOIN t USING (token) JOIN (SELECT query_id, count(*) AS total FROM q GROUP BY query_id) USING (query_id) GROUP BY query_id, shard_id)
SELECT query_id, shard_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard_id)::INTEGER AS rank FROM s QUALIFY rank <= 9
""")
def k02_shard_ranking(spark, sf):
    shards = snapshot.manifest(_sharded(spark, sf))
    ranked = snapshot.rank_shards(shards, benchmark_queries(spark, sf)).filter(F.col("rank") <= snapshot.MOST_READS)
    return ranked.select("query_id", "shard_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH RECURSIVE {_SHARD_SQL},
s AS (SELECT source, source || ':' || lpad(shard::VARCHAR, 8, '0') AS shard_id, shard, sum(bytes)::BIGINT AS byte_length FROM g GROUP BY source, shard)
SELECT shard_id FROM s WHERE shard % 2 = 1
""")
def w06_layout_faults(spark, sf):
    """Manifest rows whose offset is off by one: those that were tampered with."""
    shards = snapshot.offsets(snapshot.manifest(_sharded(spark, sf)))
    number = F.substring_index("shard_id", ":", -1).cast("bigint")
    off = shards.withColumn("byte_offset", F.col("byte_offset") + F.when(number % 2 == 1, 1).otherwise(0))
    off = off.withColumn("byte_length", F.col("byte_length") - F.when(number % 2 == 1, 1).otherwise(0))
    return snapshot.layout_faults(off).select("shard_id")


def _event_stream(spark, sf):
    events = read(spark, sf, "events")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def _drained(stream, spark, mode="append"):
    """All that a stream gives for the files that are there now, as a table."""
    out = scratch_path(spark, "stream")
    with streams.rocksdb_state(spark):
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query(SQL["w09_rate_decisions"])
def t02_rate_stream(spark, sf):
    """The rate decisions of w09 over the events table as a stream."""
    made = _drained(streams.rate_stream(_event_stream(spark, sf), limit=2, seconds=3600), spark)
    return made.select(F.col("event_id").alias("event"), F.col("user_id").alias("key"), "allowed")


@query("SELECT user_id AS source, event_type AS revision, 1::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def t03_new_revisions(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("user_id").alias("source"), F.col("event_type").alias("revision"), F.col("ts").cast("timestamp").alias("observed_at"))
    return _drained(streams.new_revisions(rows, "3650 days"), spark).groupBy("source", "revision").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT user_id AS owner, time_bucket(INTERVAL '5 minutes', ts::TIMESTAMP) AS start, max(ts::TIMESTAMP) AS last, count(*) AS n FROM events GROUP BY ALL)
SELECT owner, epoch_us(start) AS start_micros, epoch_us(last) AS last_micros, n FROM w WHERE start + INTERVAL '10 minutes' <= (SELECT max(ts::TIMESTAMP) FROM events)
""")
def t04_freshness(spark, sf):
    """Windows that the watermark has closed."""
    rows = _event_stream(spark, sf).select(F.col("user_id").alias("owner"), F.col("ts").cast("timestamp").alias("observed_at"))
    closed = _drained(streams.freshness(rows), spark)
    return closed.select("owner", F.unix_micros("window.start").alias("start_micros"), F.unix_micros("last").alias("last_micros"), "n")


@query("""
WITH e AS (SELECT user_id AS owner, ts::TIMESTAMP AS seen, lead(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts::TIMESTAMP) AS next FROM events)
SELECT owner, epoch_us(seen) AS last_micros FROM e
WHERE (next IS NULL OR next > seen + INTERVAL '1 hour') AND seen + INTERVAL '1 hour' <= (SELECT date_trunc('milliseconds', max(ts::TIMESTAMP)) - INTERVAL '5 minutes' FROM events)
""")
def t04_silences(spark, sf):
    """Every silence of an hour of a user of the events table."""
    rows = _event_stream(spark, sf).select(F.col("user_id").alias("owner"), F.col("ts").cast("timestamp").alias("observed_at"))
    return _drained(streams.silences(rows, minutes=60), spark)

"""Queries over text and record functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import records as R
from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import ingest
from paperloom.plans import sqltext as Q
from paperloom.plans.registry import query, read

#: A pipeline revision for the tests' sources.
PIPELINE = "v11:content-sniffer-v2:quota-controls:quality-ocr-smart:cloud-read-off:embedding-gemini:chunk-1200"


@query(f"SELECT doc_id, md5({Q.norm('text')}) AS normalized_md5, length({Q.norm('text')}) AS n FROM documents")
def p01_normalize_search_text(spark, sf):
    n = T.normalize_search_text(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(n).alias("normalized_md5"), F.length(n).alias("n"))


@query(f"SELECT doc_id, len({Q.tokens('text')}) AS n_tokens, md5(array_to_string({Q.tokens('text')}, ' ')) AS tokens_md5 FROM documents")
def p02_search_tokens(spark, sf):
    t = T.search_tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("SELECT doc_id, '0x' || sha256(text) AS content_hash FROM documents")
def p03_content_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"""
SELECT doc_id, round(q, 6) AS quality, n_words >= 5 AND q >= 0.68 AS useful
FROM (SELECT doc_id, {Q.quality('text')} AS q, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]{{2,}}')) AS n_words FROM documents)
""")
def p04_text_quality(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text", T.text_quality(F.col("text")).alias("q"))
    return rows.select("doc_id", F.round("q", 6).alias("quality"), T.is_useful(F.col("text"), F.col("q")).alias("useful"))


@query()
def p05_chunk_text(spark, sf):
    cut = ingest.chunks(ingest.pages(read(spark, sf, "documents")))
    return cut.select("document_id", "chunk_index", F.length("text").alias("chars"), "content_hash")


@query(r"""
WITH t AS (SELECT doc_id, doc_id % 5000 || '. ' || upper(replace(text, 'ß', 'ss')) AS body FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(body, '\b(\d{1,4})[\s]*[-.):][\s]*([A-ZÀ-Ỵ][A-ZÀ-Ỵ\s,''’ -]{3,100})', 1)) AS number,
             unnest(regexp_extract_all(body, '\b(\d{1,4})[\s]*[-.):][\s]*([A-ZÀ-Ỵ][A-ZÀ-Ỵ\s,''’ -]{3,100})', 2)) AS title FROM t)
SELECT doc_id AS document_id, number::INTEGER AS number, md5(""" + Q.collapse("title") + r""") AS title_md5, 1 AS page_number
FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, number::INTEGER) = 1
""")
def p07_numbered_headings(spark, sf):
    docs = read(spark, sf, "documents")
    page = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.concat((F.col("doc_id") % 5000).cast("string"), F.lit(". "), F.upper(F.regexp_replace("text", "ß", "ss"))).alias("raw_text"))
    return ingest.headings(page).select("document_id", "number", F.md5("title").alias("title_md5"), "page_number")


@query(f"""
WITH d AS (SELECT doc_id, {Q.collapse('text')} AS flat, substr(text, length(text) // 2 + 1, 20) AS needle FROM documents),
p AS (SELECT doc_id, flat, needle, instr({Q.norm('flat')}, {Q.norm('needle')}) AS place FROM d)
SELECT doc_id, trim(substr(flat, greatest(0, place - 141) + 1, greatest(length(needle) + 280, 420)), ' ') AS excerpt FROM p
""")
def p08_excerpt_around(spark, sf):
    needle = F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1, 20)")
    return read(spark, sf, "documents").select("doc_id", T.excerpt_around(F.col("text"), needle).alias("excerpt"))


@query(f"""
WITH t AS (SELECT doc_id, {Q.tokens('text')} AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 THEN 0.0 ELSE len(list_filter(a.w, lambda x: list_contains(list_distinct(b.w), x)))::DOUBLE / len(a.w) END, 6) AS coverage,
       round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0
             ELSE len(list_intersect(list_distinct(a.w), list_distinct(b.w)))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1
""")
def p09_p10_coverage_jaccard(spark, sf):
    words = read(spark, sf, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("w"))
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), F.array_distinct("w").alias("x"))
    both = words.join(after, "doc_id")
    return both.select("doc_id", F.round(T.token_coverage(F.col("w"), F.col("x")), 6).alias("coverage"), F.round(T.token_jaccard(F.col("w"), F.col("x")), 6).alias("jaccard"))


@query("""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def p11_cosine(spark, sf):
    e = read(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(r"""
WITH s AS (
  SELECT 'page' AS tbl, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents
  UNION ALL SELECT 'event', event_id, props FROM events)
SELECT tbl, id, 'document' AS kind,
       CASE WHEN regexp_matches(ltrim(body), '^[\{\[]') THEN 'JSON'
            WHEN regexp_matches(ltrim(body), '(?i)^(<!doctype\s+html|<html\b)') THEN 'HTML'
            WHEN regexp_matches(ltrim(body), '^<\?xml\b') THEN 'XML' ELSE 'TEXT' END AS format
FROM s
""")
def p12_sniff_content(spark, sf):
    parts = [("page", "pages", "page_id", "html"), ("document", "documents", "doc_id", "text"), ("event", "events", "event_id", "props")]
    rows = [read(spark, sf, t).select(F.lit(n).alias("tbl"), F.col(i).alias("id"), F.col(c).alias("body")) for n, t, i, c in parts]
    said = rows[0].unionByName(rows[1]).unionByName(rows[2]).select("tbl", "id", R.sniff(F.col("body").cast("binary")).alias("s"))
    return said.select("tbl", "id", "s.kind", "s.format")


_EXTENSIONS = ["pdf", "PNG", "mp4", "kb.json", "zip", "md", "jpeg", "yaml"]
_NAME_SQL = "doc_id || '.' || [" + ", ".join(f"'{e}'" for e in _EXTENSIONS) + "][(doc_id % 8)::INTEGER + 1]"


def _name():
    return F.concat(F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int")))


@query(rf"""
SELECT doc_id, CASE WHEN regexp_matches(n, '(?i)\.(kb\.json|kb-snapshot\.json|kb-snapshot\.pack)$') THEN 'package'
  WHEN regexp_matches(n, '(?i)\.(jpg|jpeg|png|gif|webp)$') THEN 'image' WHEN regexp_matches(n, '(?i)\.(mp4|m4v|mov)$') THEN 'video'
  WHEN regexp_matches(n, '(?i)\.(pdf|txt|md|markdown|csv|tsv|json|jsonl|html?|xml|ya?ml)$') THEN 'document' ELSE 'unsupported' END AS kind
FROM (SELECT doc_id, {_NAME_SQL} AS n FROM documents)
""")
def p13_input_kind(spark, sf):
    return read(spark, sf, "documents").select("doc_id", R.input_kind(_name()).alias("kind"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN (epoch_us(o_orderdate) // 1000000) * 1000000 WHEN 1 THEN (epoch_us(o_orderdate) // 1000) * 1000
    WHEN 2 THEN epoch_us(o_orderdate) ELSE NULL END::BIGINT AS micros
FROM orders
""")
def p14_parse_timestamp(spark, sf):
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    shape = F.col("o_orderkey") % 4
    raw = F.when(shape == 0, F.floor(micros / 1_000_000).cast("string")).when(shape == 1, F.floor(micros / 1000).cast("string")).when(shape == 2, micros.cast("string")).otherwise("not a date")
    return read(spark, sf, "orders").select("o_orderkey", R.parse_timestamp_micros(raw).alias("micros"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'allowlist' WHEN o_orderpriority LIKE '2%' THEN 'purchasable'
  WHEN o_orderpriority LIKE '3%' THEN 'time_lock' ELSE 'public' END AS tag FROM orders
""")
def p15_access_tag(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    raw = F.when(p == "1", " Allow-List ").when(p == "2", "PAID").when(p == "3", "time lock").when(p == "4", F.lit(None)).otherwise("other")
    return read(spark, sf, "orders").select("o_orderkey", R.normalize_access_tag(raw).alias("tag"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'mainnet' ELSE 'testnet' END AS network,
       CASE WHEN c_nationkey % 2 = 0 THEN lower(c_name) ELSE 'other:' || lower(c_name) END AS owner FROM customer
""")
def p18_workspace_key(spark, sf):
    even = F.col("c_nationkey") % 2 == 0
    key = F.when(even, R.workspace_key(F.lit("MAINNET"), F.col("c_name"))).otherwise(F.concat(F.lit("other:"), F.col("c_name")))
    parsed = read(spark, sf, "customer").select("c_custkey", R.parse_workspace_key(key).alias("k"))
    return parsed.select("c_custkey", "k.network", "k.owner")


@query(f"""
SELECT doc_id, n_chars || ':' || doc_id || ':public:{PIPELINE}' AS revision, n_chars || ':' || doc_id || ':public' AS identity FROM documents
""")
def p19_revision(spark, sf):
    revision = R.build_revision(F.col("n_chars"), F.col("doc_id"), F.lit("public"), F.lit(PIPELINE))
    return read(spark, sf, "documents").select("doc_id", revision.alias("revision")).withColumn("identity", R.content_identity(F.col("revision")))


#: An answer that cites by rules, from a conversation's row.
ANSWER_SQL = "text || ' [s' || (turn % 3 + 1) || ', S0' || (conv_id % 4 + 1) || '] see S9 [S' || (turn % 3 + 1) || ']'"


def answer():
    n = lambda c, k: (F.col(c) % k + 1).cast("string")
    return F.concat("text", F.lit(" [s"), n("turn", 3), F.lit(", S0"), n("conv_id", 4), F.lit("] see S9 [S"), n("turn", 3), F.lit("]"))


CITED_SQL = r"""
list_distinct(list_transform(flatten(list_transform(regexp_extract_all({0}, '\[([^\]]+)\]', 1), lambda g: regexp_extract_all(g, '\b[Ss](\d+)\b', 1))), lambda n: 'S' || n::INTEGER))
"""


@query(f"SELECT conv_id, turn, array_to_string(list_sort({CITED_SQL.format('a')}), ',') AS cited FROM (SELECT conv_id, turn, {ANSWER_SQL} AS a FROM conversations)")
def p20_citation_ids(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(R.citation_ids(answer())), ",").alias("cited"))


@query("""
SELECT doc_id, trim(substr(replace(text, '"', ''''), 1, 12)) AS quote FROM (SELECT doc_id, regexp_replace(text, '[''"“”‘’]', '', 'g') AS text FROM documents) WHERE length(text) >= 8
""")
def p21_quoted_text(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "['\"“”‘’]", "").alias("text")).filter(F.length("text") >= 8)
    asked = F.concat(F.lit("where is “"), F.substring("text", 1, 12), F.lit("” and 'short'"))
    return docs.select("doc_id", T.longest_quote(asked).alias("quote"))


@query("""
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN norm = 0 THEN 1 ELSE norm END) AS v FROM n),
s AS (SELECT vec_id, v, greatest(1e-6, list_max(list_transform(v, lambda x: abs(x)))) / 127 AS scale FROM u)
SELECT vec_id, round(scale, 9) AS scale, list_sum(list_transform(v, lambda x: greatest(1, least(255, floor(x / scale + 0.5) + 128))))::BIGINT AS code_sum FROM s
""")
def p28_quantize(spark, sf):
    q = read(spark, sf, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q"))
    total = F.aggregate("q.codes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), total.alias("code_sum"))

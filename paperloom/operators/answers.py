"""Audits over logged answers: citations, grounding, verification levels, receipts, stated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import access as A
from paperloom.functions import records as R
from paperloom.functions import text as T

LEVELS = ["failed", "indexed_only", "source_verified", "content_verified"]
# Fixed values.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "không": 0, "một": 1, "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10,
}
EXCERPT_FORM = "nfc-lowercase-vi-whitespace-v1"
READ_BY_MODEL = ["local_ocr", "cloud_vision", "cloud_video", "mixed"]
HASH = r"(?i)^(0x)?[0-9a-f]{64}$"
# End of fixed values.


def cited_rows(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (``answer_id, citation_id, ...``) that their answer cites."""
    cited = answers.select("answer_id", F.explode(R.citation_ids(F.col("answer"))).alias("citation_id"))
    return candidates.join(cited, ["answer_id", "citation_id"], "left_semi")


def grounding(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """``answer_id, grounded, n_cited, n_unknown``: null without candidates (false if retrieval was tried), false if nothing known or anything unknown is cited."""
    offered = candidates.groupBy("answer_id").agg(F.collect_set("citation_id").alias("offered"))  # a bounded list per answer
    joined = answers.join(offered, "answer_id", "left").withColumn("cited", R.citation_ids(F.col("answer")))
    known = F.size(F.array_intersect("cited", F.coalesce("offered", F.array().cast("array<string>"))))
    unknown = F.size("cited") - known
    grounded = F.when(F.col("offered").isNull(), F.when(F.col("retrieval_attempted"), False)).otherwise((known > 0) & (unknown == 0))
    return joined.select("answer_id", grounded.alias("grounded"), known.alias("n_cited"), unknown.alias("n_unknown"))


def receipt_level(sources: DataFrame) -> DataFrame:
    """``receipt_id, level``: the worst level of each receipt's sources."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    worst = sources.groupBy("receipt_id").agg(F.min(rank).alias("worst"))
    return worst.select("receipt_id", F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.col("worst"), F.lit(1)).cast("int")).alias("level"))


def citation_integrity(citation_id: Column, source: Column, page_number: Column, excerpt: Column) -> Column:
    """``excerpt_sha256, citation_sha256``: of the normalised excerpt, and of the canonical record around it."""
    inner = F.sha2(T.normalize_search_text(excerpt), 256)
    record = F.to_json(F.struct(citation_id.alias("citationId"), inner.alias("excerptSha256"), page_number.alias("pageNumber"), source.alias("source")))
    return F.struct(inner.alias("excerpt_sha256"), F.sha2(record, 256).alias("citation_sha256"))


def verify_excerpts(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """``claim_id, level``: content_verified where the page still holds the excerpt and its hash, else source_verified or failed."""
    now = pages.select("document_id", "page_number", F.col("content_hash").alias("now_hash"), "normalized_text")
    joined = claims.join(now, ["document_id", "page_number"], "left")
    held = F.contains("normalized_text", T.normalize_search_text(F.col("excerpt")))
    same = T.normalize_hex(F.col("page_hash")) == T.normalize_hex(F.col("now_hash"))
    level = F.when(F.col("now_hash").isNull(), "failed").when(held & same, "content_verified").when(same, "failed").otherwise("indexed_only")
    return joined.select("claim_id", level.alias("level"))


def count_facts(answer: Column, units: list[str]) -> Column:
    """Distinct numbers, as digits or words, that stand before one of the unit words."""
    plain = F.lower(F.regexp_replace(answer, r"[*_`~]", ""))
    unit = "(?:" + "|".join(units) + ")"
    digits = F.transform(F.regexp_extract_all(plain, F.lit(rf"(?<![\p{{L}}\p{{N}}.,])(\d+)\s+{unit}(?![\p{{L}}\p{{N}}])"), F.lit(1)), lambda d: d.cast("bigint"))
    names = "|".join(NUMBER_WORDS)
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![\p{{L}}\p{{N}}])({names})\s+{unit}(?![\p{{L}}\p{{N}}])"), F.lit(1))
    table = F.create_map(*[x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return F.array_sort(F.array_distinct(F.concat(digits, F.transform(found, lambda w: F.element_at(table, w)))))


def answer_contract(answer: Column, offered: Column, exact_facts: Column, allowed_counts: Column, units: list[str], leak_marks: list[str]) -> Column:
    """The first rule that an answer breaks: leak, missing_citation, unknown_citation, missing_exact_fact, invalid_count_fact; else valid."""
    cited = R.citation_ids(answer)
    low = F.lower(answer)
    stem = lambda f: F.regexp_replace(F.lower(f), r"\.[^.]{1,5}$", "")
    stated = lambda f: F.contains(low, F.lower(f)) | ((F.length(stem(f)) >= 4) & F.contains(low, stem(f)))
    return (
        F.when(A.holds_any(answer, leak_marks), "leak")
        .when((F.size(offered) > 0) & (F.size(cited) == 0), "missing_citation")
        .when(F.size(F.array_except(cited, offered)) > 0, "unknown_citation")
        .when(F.exists(exact_facts, lambda f: ~stated(f)), "missing_exact_fact")
        .when(F.size(F.array_except(count_facts(answer, units), allowed_counts)) > 0, "invalid_count_fact")
        .otherwise("valid")
    )


def fill_citation_ids(sources: DataFrame) -> DataFrame:
    """``answer_id, position, citation_id``: given valid ids stay, the others get the smallest free numbers in order."""
    from pyspark.sql import Window

    valid = F.regexp_extract(F.upper(F.trim(F.coalesce("citation_id", F.lit("")))), r"^S([1-9]\d*)$", 1)
    rows = sources.select("answer_id", "position", F.when(valid != "", valid.cast("int")).alias("given"))
    gap = Window.partitionBy("answer_id").orderBy("position")
    total = rows.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("given").alias("used"))
    free = total.select("answer_id", F.posexplode(F.array_except(F.sequence(F.lit(1), F.col("n") + F.size("used")).cast("array<int>"), F.col("used"))).alias("k", "number"))
    open_rows = rows.filter("given IS NULL").withColumn("k", F.row_number().over(gap) - 1)
    filled = open_rows.join(free, ["answer_id", "k"]).select("answer_id", "position", "number")
    kept = rows.filter("given IS NOT NULL").select("answer_id", "position", F.col("given").alias("number"))
    return kept.unionByName(filled).select("answer_id", "position", F.concat(F.lit("S"), F.col("number")).alias("citation_id"))


def verification_scope(level: Column, method: Column) -> Column:
    """What a source's level rests on."""
    return (
        F.when(level == "failed", "verification_failed")
        .when(level == "indexed_only", "index_record_only")
        .when(method.isin(READ_BY_MODEL), "source_bytes_only_ocr_not_independently_verified")
        .when((level == "content_verified") & (method == "text_layer"), "text_layer_excerpt_reproduced_at_creation")
        .otherwise("source_bytes_verified_at_creation")
    )


def receipt_audit(receipts: DataFrame, sources: DataFrame, integrity: DataFrame) -> DataFrame:
    """Checks of each receipt against itself, one row per receipt: ``schema, receipt_id_check, envelope_digest, citations, excerpt_hashes,
    declared_hashes, evidence_scope`` (pass, fail, unavailable or declared_only), ``n_errors`` and ``valid``.

    ``receipts``: receipt_id, answer, body and declared_id (the canonical text and its SHA-256), payload and digest likewise.
    ``sources``: receipt_id, citation_id, source, page_number, excerpt, level, method, indexed_root, current_root, recomputed_root, page_hash, chunk_hash.
    ``integrity``: receipt_id, citation_id, source, page_number, excerpt_form, excerpt_sha256, citation_sha256, page_sha256, chunk_sha256, scope, method.
    Rows meet by receipt and citation; a receipt's sources are counted, not gathered.
    """
    hashed = lambda c: c.rlike(HASH)
    plain = T.normalize_hex
    ok = lambda c: F.coalesce(c, F.lit(False))
    same = lambda a, b: plain(a).eqNullSafe(plain(b))
    roots = F.array_compact(F.array(*[plain(F.col(c)) for c in ("indexed_root", "current_root", "recomputed_root")]))
    wrong_hash = F.lit(False)
    for c in ("indexed_root", "current_root", "recomputed_root", "page_hash", "chunk_hash"):
        wrong_hash = wrong_hash | ok(~hashed(F.col(c)))
    expected = citation_integrity(F.upper("citation_id"), F.col("source"), F.col("page_number"), F.col("excerpt"))
    own = sources.select(
        "*",
        F.upper("citation_id").alias("cite"),
        expected.alias("want"),
        verification_scope(F.col("level"), F.col("method")).alias("want_scope"),
        (wrong_hash | ((F.col("level") != "failed") & (F.size(F.array_distinct(roots)) > 1))).alias("hash_error"),
        ((F.col("level") == "content_verified") & F.col("method").isin(READ_BY_MODEL)).alias("claim_error"),
        (F.col("page_hash").isNotNull() | F.col("chunk_hash").isNotNull()).alias("declares"),
    )
    told = integrity.select("receipt_id", F.upper("citation_id").alias("cite"), F.struct(*[integrity[c] for c in integrity.columns if c != "receipt_id"]).alias("told"))
    first = told.groupBy("receipt_id", "cite").agg(F.first("told").alias("told"))
    cited = receipts.select("receipt_id", F.explode(R.citation_ids(F.col("answer"))).alias("cite"), F.lit(True).alias("is_cited"))
    met = own.join(first, ["receipt_id", "cite"], "left").join(cited, ["receipt_id", "cite"], "left")
    t, want = F.col("told"), F.col("want")
    missing = t.isNull()
    as_declared = lambda c: F.when(hashed(F.col(c)), plain(F.col(c)))
    rows = met.select(
        "receipt_id", "cite", "declares",
        (~F.col("cite").rlike(r"^S[1-9]\d*$") | ok(F.col("claim_error")) | F.col("is_cited").isNull()).alias("citation_error"),
        ok(F.col("hash_error")).alias("hash_error"),
        (missing | ~ok((t["citation_id"] == F.col("cite")) & (t["source"] == F.col("source")) & (t["page_number"] == F.col("page_number")) & (t["citation_sha256"] == want["citation_sha256"]))).alias("binding_error"),
        (missing | ~ok((t["excerpt_form"] == EXCERPT_FORM) & (t["excerpt_sha256"] == want["excerpt_sha256"]))).alias("excerpt_error"),
        F.when(missing, F.col("declares")).otherwise(~same(t["page_sha256"], as_declared("page_hash")) | ~same(t["chunk_sha256"], as_declared("chunk_hash"))).alias("declared_error"),
        (missing | ~ok(t["scope"].eqNullSafe(F.col("want_scope")) & t["method"].eqNullSafe(F.col("method")))).alias("scope_error"),
    )
    kinds = ["citation_error", "hash_error", "binding_error", "excerpt_error", "declared_error", "scope_error"]
    per = rows.groupBy("receipt_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cite").alias("n_cites"), F.bool_or("declares").alias("declares"), *[F.count_if(F.col(k)).alias(k) for k in kinds])
    records = integrity.groupBy("receipt_id").agg(F.count(F.lit(1)).alias("n_records"))
    known = own.select("receipt_id", "cite").distinct().withColumn("known", F.lit(True))
    strays = cited.join(known, ["receipt_id", "cite"], "left").groupBy("receipt_id").agg(F.count(F.lit(1)).alias("n_cited"), F.count_if(F.col("known").isNull()).alias("n_stray"))
    joined = receipts.join(per, "receipt_id", "left").join(records, "receipt_id", "left").join(strays, "receipt_id", "left")
    joined = joined.na.fill(0, ["n", "n_cites", "n_records", "n_cited", "n_stray", *kinds]).na.fill(False, ["declares"])
    right = lambda text, digest: ok(plain(digest) == F.sha2(text, 256))
    verdict = lambda bad: F.when(bad, "fail").otherwise("pass")
    c = F.col
    schema = ok(hashed(c("declared_id")) & hashed(c("digest")) & c("answer").isNotNull())
    id_right, digest_right = right(c("body"), c("declared_id")), right(c("payload"), c("digest"))
    repeated, uncited = c("n") - c("n_cites"), F.when((c("n") > 0) & (c("n_cited") == 0), 1).otherwise(0)
    records_off = F.when(c("n_records") != c("n"), 1).otherwise(0)
    citation_errors = c("citation_error") + c("binding_error") + repeated + uncited + c("n_stray") + records_off
    errors = citation_errors + c("hash_error") + c("excerpt_error") + c("declared_error") + c("scope_error")
    errors = errors + F.when(schema, 0).otherwise(1) + F.when(id_right, 0).otherwise(1) + F.when(digest_right, 0).otherwise(1)
    return joined.select(
        "receipt_id",
        verdict(~schema).alias("schema"),
        verdict(~id_right).alias("receipt_id_check"),
        verdict(~digest_right).alias("envelope_digest"),
        verdict(citation_errors > 0).alias("citations"),
        verdict(c("excerpt_error") > 0).alias("excerpt_hashes"),
        F.when(c("hash_error") + c("declared_error") > 0, "fail").when(c("declares"), "declared_only").otherwise("unavailable").alias("declared_hashes"),
        verdict(c("scope_error") > 0).alias("evidence_scope"),
        errors.cast("bigint").alias("n_errors"),
        (errors == 0).alias("valid"),
    )

"""Portable packages: documents with nested pages, chunks and stories, written and read as JSON lines with a fixed schema.

Defined results: an absent vector is null and breaks no rule; an empty table gives an empty package; a document without pages, chunks or
stories has empty arrays; other columns of the tables are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MAX_DOCUMENTS, MAX_PAGES, MAX_CHUNKS, MAX_DIMENSIONS = 512, 100_000, 100_000, 4096
MAX_CHARACTERS, MAX_STORY_TITLE = 96 * 1024 * 1024, 1000
# End of fixed values.
PAGES = "array<struct<page_number: int, total_pages: int, raw_text: string>>"
CHUNKS = "array<struct<chunk_index: int, page_number: int, text: string, vector: array<double>>>"
STORIES = "array<struct<number: double, title: string, page_number: int>>"
SCHEMA = f"source string, title string, pages {PAGES}, chunks {CHUNKS}, stories {STORIES}"


def export(manifest: DataFrame, pages: DataFrame, chunks: DataFrame, stories: DataFrame | None = None, vectors: DataFrame | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """A row per indexed document with its pages, chunks and stories in order. ``document_id`` joins the tables and is dropped.

    ``stories(document_id, number, title, page_number)`` and ``vectors(document_id, chunk_index, vector)`` may be left out. With
    ``eligible(source)`` only those sources leave.
    """
    listed = manifest.filter("status = 'indexed'")
    if eligible is not None:
        listed = listed.join(eligible.select("source").distinct(), "source", "left_semi")
    if vectors is not None:
        chunks = chunks.join(vectors.select("document_id", "chunk_index", F.col("vector").cast("array<double>").alias("vector")), ["document_id", "chunk_index"], "left")
    else:
        chunks = chunks.withColumn("vector", F.lit(None).cast("array<double>"))
    parts = [(pages, "pages", PAGES, ("page_number", "total_pages", "raw_text")), (chunks, "chunks", CHUNKS, ("chunk_index", "page_number", "text", "vector"))]
    if stories is not None:
        parts.append((stories, "stories", STORIES, ("number", "title", "page_number")))
    for table, name, kind, fields in parts:
        nested = table.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).cast(kind).alias(name))
        listed = listed.join(nested, "document_id", "left")
    if stories is None:
        listed = listed.withColumn("stories", F.lit(None).cast(STORIES))
    empty = [F.coalesce(name, F.array().cast(kind)).alias(name) for name, kind in (("pages", PAGES), ("chunks", CHUNKS), ("stories", STORIES))]
    return listed.select("source", "title", *empty)


def write(package: DataFrame, path: str) -> None:
    """JSON lines; rows with a ``package_id`` are many packages, a folder each."""
    package.write.mode("overwrite").partitionBy(*_ids(package)).json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A package, or many with their ``package_id``."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def _ids(package: DataFrame) -> list[str]:
    return [c for c in package.columns if c == "package_id"]


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def _characters(items: str, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x[field]), F.lit(0)))


def violations(package: DataFrame) -> DataFrame:
    """``source, rule`` for every rule that a package's document breaks; import goes on only if there is none. Rules of the whole package have no source.
    Where rows have a ``package_id``, the rows that come back have it too, and each package is judged by itself."""
    ids = _ids(package)
    numbers = F.transform("pages", lambda p: p["page_number"])
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = lambda test: F.exists("chunks", lambda c: c["vector"].isNotNull() & test(c["vector"]))
    rules = [
        (_blank(F.col("source")), "no_source"),
        (F.size("pages") == 0, "no_pages"),
        (F.size(F.array_distinct(numbers)) < F.size("pages"), "repeated_page"),
        (F.exists("pages", lambda p: ~((p["page_number"] >= 1) & (p["page_number"] <= p["total_pages"])) & ~((p["page_number"] == 0) & (p["total_pages"] == 0))), "page_out_of_range"),
        (F.exists("chunks", lambda c: ~F.array_contains(numbers, c["page_number"])), "chunk_without_page"),
        (F.exists("chunks", lambda c: _blank(c["text"])), "empty_chunk"),
        (vector(lambda v: ~F.forall(v, finite)), "vector_not_finite"),
        (vector(lambda v: F.size(v) > MAX_DIMENSIONS), "vector_too_long"),
        (F.exists("stories", lambda s: ~F.coalesce(finite(s["number"]) & (s["number"] >= 0), F.lit(False))), "story_number"),
        (F.exists("stories", lambda s: _blank(s["title"]) | (F.length(s["title"]) > MAX_STORY_TITLE)), "story_title"),
        (F.exists("stories", lambda s: ~F.coalesce(s["page_number"] >= 1, F.lit(False))), "story_page"),
    ]
    broken = package.select(*ids, "source", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("rule"))
    repeated = package.groupBy(*ids, "source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*ids, "source", F.lit("repeated_source").alias("rule"))
    characters = _characters("pages", "raw_text") + _characters("chunks", "text") + _characters("stories", "title")
    totals = package.groupBy(*ids).agg(F.count(F.lit(1)).alias("d"), F.sum(F.size("pages")).alias("p"), F.sum(F.size("chunks")).alias("c"), F.sum(characters).alias("chars"))
    over = [((F.col("d") > MAX_DOCUMENTS) | (F.col("p") > MAX_PAGES) | (F.col("c") > MAX_CHUNKS), "too_large"), (F.col("chars") > MAX_CHARACTERS, "too_many_characters")]
    whole = totals.select(*ids, F.lit(None).cast("string").alias("source"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in over]))).alias("rule"))
    return broken.unionByName(repeated).unionByName(whole)


def accepted(packages: DataFrame) -> DataFrame:
    """The rows of those ``package_id`` that break no rule."""
    return packages.join(violations(packages).select("package_id").distinct(), "package_id", "left_anti")


def import_tables(package: DataFrame, owner: str, eligible: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables ``manifest, pages, chunks, stories`` of a package under ids of the importing ``owner``; all or nothing.

    ``ValueError`` names the broken rules. With ``eligible(source)`` sources that aren't there any more are left out. A document whose
    chunks have a vector is ``ready`` for vector search, others are ``unavailable``.
    """
    faults = [r["rule"] for r in violations(package).select("rule").distinct().orderBy("rule").collect()]
    if faults:
        raise ValueError(f"the package breaks rules: {', '.join(faults)}")
    if eligible is not None:
        package = package.join(eligible.select("source").distinct(), "source", "left_semi")
    keyed = package.withColumn("owner", F.lit(owner)).withColumn("document_id", F.sha2(F.concat_ws("\n", "owner", "source"), 256))
    ready = F.exists("chunks", lambda c: F.size(F.coalesce(c["vector"], F.array().cast("array<double>"))) > 0)
    own = ["owner", "document_id", "source"]
    tables = {name: keyed.select(*own, F.inline(name)) for name in ("pages", "chunks", "stories")}
    return {"manifest": keyed.select(*own, "title", F.lit("indexed").alias("status"), F.when(ready, "ready").otherwise("unavailable").alias("vector_status"))} | tables

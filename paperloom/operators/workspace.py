"""A workspace's tables and its reports: registered names, books, call and storage estimates, images, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T

# Fixed values.
CONFIRMED = 0.7
IMAGES, VIDEOS, BOOKS = r"(?i)\.(jpe?g|png|gif|webp)$", r"(?i)\.(mp4|m4v|mov)$", r"(?i)\.pdf$"
MAX_CHUNKS, VECTORS_PER_CALL, KNOWN_COVERAGE = 3000, 20, 0.85
DESCRIPTION = r"(?is)(?:AI description|Mô tả AI):\s*(.+)"
# End of fixed values.


def object_name(account: Column, name: Column) -> Column:
    return F.concat(F.lit("@"), account, F.lit("/"), name)


def resolve_registered(requests: DataFrame, registered: DataFrame) -> DataFrame:
    """``requests`` (account, name) with the ``uid`` registered under their object name (``object_name, uid``), and ``missing`` where none is."""
    named = requests.withColumn("object_name", object_name(F.col("account"), F.col("name")))
    last = registered.groupBy("object_name").agg(F.max("uid").alias("uid"))
    return named.join(last, "object_name", "left").withColumn("missing", F.col("uid").isNull())


def book_inventory(names: DataFrame, metadata: DataFrame) -> DataFrame:
    """Books among ``names(name)`` with title, aliases and pages from ``metadata(source, title, aliases, pages, confidence)``; ``confirmed`` from a confidence of 0.7 on."""
    told = metadata.select(F.col("source").alias("name"), "title", "aliases", "pages", "confidence")
    joined = names.filter(F.col("name").rlike(BOOKS)).join(told, "name", "left")
    return joined.select("name", "title", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "pages", (F.coalesce("confidence", F.lit(0.0)) >= CONFIRMED).alias("confirmed"))


def call_estimate(items: DataFrame, content: bool = True, semantic: bool = True, all_pages: bool = False, chunk_size: int = 1200) -> DataFrame:
    """One row: content calls at least, whether more may come, about how many vector calls, and whether there is a video.

    ``items``: name, size, page_count, text_coverage, chunks; all but the name may be null.
    """
    name = F.col("name")
    image, video, book = name.rlike(IMAGES), name.rlike(VIDEOS), name.rlike(BOOKS)
    counted = F.coalesce("page_count", F.lit(0)) > 0
    covered = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("text_coverage", F.lit(KNOWN_COVERAGE))))
    thin = F.greatest(F.lit(1), F.ceil(F.col("page_count") * (1 - covered)))
    calls = F.when(image | video, 1).when(book & counted, F.col("page_count") if all_pages else thin).when(book, 1).otherwise(0)
    guess = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), F.coalesce("size", F.lit(chunk_size))) / max(1, 3 * chunk_size)))
    chunks = F.when(F.coalesce("chunks", F.lit(0)) > 0, F.col("chunks")).when(video, 1).otherwise(guess)
    vectors = F.when(image, 0).otherwise(F.ceil(F.least(F.lit(MAX_CHUNKS), chunks) / VECTORS_PER_CALL))
    return items.agg(
        F.coalesce(F.sum(calls if content else F.lit(0)), F.lit(0)).cast("bigint").alias("content_calls"),
        F.coalesce(F.bool_or(book & ~counted) if content else F.lit(False), F.lit(False)).alias("uncertain"),
        F.coalesce(F.sum(vectors if semantic else F.lit(0)), F.lit(0)).cast("bigint").alias("vector_calls"),
        F.coalesce(F.bool_or(video), F.lit(False)).alias("has_video"),
    )


def storage_bytes(rows: DataFrame, owner: str) -> DataFrame:
    """``owner, bytes``: what each owner's rows take as JSON."""
    record = F.to_json(F.struct(*[rows[c] for c in rows.columns if c != owner]))
    return rows.groupBy(rows[owner].alias("owner")).agg(F.sum(F.octet_length(record)).cast("bigint").alias("bytes"))


def mark_unverified(inventory: DataFrame, owners: DataFrame, key: str = "owner") -> DataFrame:
    """The inventory as it was last known good, ``verified`` false for the given owners."""
    gone = owners.select(key).distinct().withColumn("invalidated", F.lit(True))
    joined = inventory.join(gone, key, "left")
    return joined.withColumn("verified", F.col("verified") & F.col("invalidated").isNull()).drop("invalidated").select(inventory.columns)


def delete_sources(rows: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("owner", "source")) -> DataFrame:
    """The rows of all but the given sources; with the owner alone as key, of all but the given workspaces."""
    return rows.join(sources.select(*keys).distinct(), list(keys), "left_anti").select(rows.columns)


def image_description(text: Column) -> Column:
    """What follows the description mark of an image's chunk, trimmed; null where there is none."""
    said = F.regexp_extract(text, DESCRIPTION, 1)
    return F.nullif(F.regexp_replace(said, r"\s+$", ""), F.lit(""))


def describe_images(chunks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``chunks(document_id, name, text, content_hash, vector)`` with new texts, hashes and no vector where ``descriptions(document_id, description)`` has one."""
    told = chunks.join(descriptions.select("document_id", "description"), "document_id", "left")
    has = F.col("description").isNotNull()
    text = F.concat(F.lit("[Image]\nFile name: "), F.col("name"), F.lit("\n\nAI description: "), F.trim("description"))
    out = told.withColumn("text", F.when(has, text).otherwise(F.col("text")))
    out = out.withColumn("content_hash", F.when(has, T.content_hash(T.normalize_search_text(F.col("text")))).otherwise(F.col("content_hash")))
    vector = F.when(~has, F.col("vector"))
    return out.withColumn("vector", vector).select(chunks.columns)

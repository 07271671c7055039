"""Snapshots: chunks in shards of whole pages, with a manifest row per shard that says which to read.

A workspace's pages are walked in order and a new shard begins where the next page would pass the target. That
is a fold, so it is done in three steps that no workspace, however large, puts into one task: ranges of pages are
folded from every place where a shard may begin in them, the ranges are chained by these results alone, and each
range is numbered from where it truly begins. A query ranks the manifest and reads only the chosen shards.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.functions.text import SHARD_STOP_WORDS
from paperloom.operators import blocks
from paperloom.session import kept

# Fixed values.
TARGET_BYTES, LEAST_BYTES, KEYWORDS = 384 * 1024, 64 * 1024, 96
WEIGHTS = {"source": 5, "display_name": 5, "title": 4, "alias": 3, "text": 1}
FIRST_READS, MORE_READS, MOST_READS, WEAK = 3, 2, 9, 0.34
SHARD_COVERAGE, SHARD_COSINE = 0.72, 0.28
CHUNK_COVERAGE, CHUNK_EXACT, CHUNK_COSINE = 0.42, 0.85, 0.5
# End of fixed values.

#: Folders of a snapshot's chunks; a shard lies in one, sorted by its name.
BUCKETS = 256


def _following(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of pages' bytes, and for each place the first page of the next shard if one begins there."""
    sums = np.r_[0, np.cumsum(sizes)]
    places = np.arange(len(sizes))
    fits = np.searchsorted(sums, sums[:-1] + target, "right") - 1
    return sums, np.maximum(fits, places + 1)


def assign_shards(chunks: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """``chunks`` (with ``owner``) with ``shard_id``: a shard per about ``target`` bytes of a workspace, no page split."""
    target, spark = max(LEAST_BYTES, target), chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["owner", "document_id", "page_number"]
    pages = chunks.groupBy(*keys).agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))
    pages = kept(pages.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), "pages")
    kinds = dict(pages.dtypes)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        """For each number of pages that may still belong to the shard before: shards begun here, and bytes in the last one."""
        sizes = part.sort_values(keys[1:])["bytes"].to_numpy()
        sums, after = _following(sizes, target)
        count, rest = np.zeros(len(sizes) + 1, np.int64), np.zeros(len(sizes) + 1, np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            j = after[i]
            count[i] = 1 + count[j]
            rest[i] = rest[j] if j < len(sizes) else sums[-1] - sums[i]
        lead = np.arange(min(len(sizes), int(np.searchsorted(sums, target, "right"))) + 1)
        return pd.DataFrame({"owner": part.owner.iloc[0], "part": part.part.iloc[0], "lead": lead, "lead_bytes": sums[lead], "begun": count[lead], "rest": rest[lead], "pages": len(sizes), "bytes": sums[-1]})

    folded = pages.groupBy("owner", "part").applyInPandas(fold, f"owner {kinds['owner']}, part int, lead bigint, lead_bytes bigint, begun bigint, rest bigint, pages bigint, bytes bigint")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where each range begins: the bytes of the shard that is open there, and its number."""
        owner, part, held, shard, ahead = object(), None, 0, -1, None
        for b in batches:
            out = []
            for o, p, lead, lead_bytes, begun, rest, pages, size in b.itertuples(index=False):
                if o != owner:
                    owner, part, held, shard, ahead = o, None, 0, -1, None
                if p != part:
                    if ahead:
                        held, shard = ahead[1], ahead[2]
                    part, ahead = p, None
                    out.append((o, p, held, shard))
                # the longest lead that still fits is where the range's own shards begin
                if (lead == 0 or held) and (lead == 0 or held + lead_bytes <= target):
                    ahead = (lead, held + lead_bytes if lead == pages else rest, shard + begun)
            yield pd.DataFrame(out, columns=["owner", "part", "held", "shard"])

    linked = folded.repartition(n, "owner").sortWithinPartitions("owner", "part", "lead")
    begun = kept(linked.mapInPandas(link, f"owner {kinds['owner']}, part int, held bigint, shard bigint"), "begun")

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(keys[1:])
        held, shard = int(part.held.iloc[0]), int(part.shard.iloc[0])
        sums, after = _following(part["bytes"].to_numpy(), target)
        numbers = np.full(len(part), shard)
        at = max(0, int(np.searchsorted(sums, target - held, "right")) - 1) if held else 0
        while at < len(part):
            shard += 1
            numbers[at : after[at]] = shard
            at = after[at]
        return pd.DataFrame({"document_id": part.document_id, "page_number": part.page_number, "shard_id": [f"{o}:{k:08d}" for o, k in zip(part.owner, numbers)]})

    told = pages.join(begun, ["owner", "part"])
    shards = told.groupBy("owner", "part").applyInPandas(number, f"document_id {kinds['document_id']}, page_number {kinds['page_number']}, shard_id string")
    return chunks.join(shards, ["document_id", "page_number"])


def keyword_postings(sharded: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``shard_id, token, n``: the weight of each token in a shard: 1 for each time in its texts, and once for each of its documents more
    where its source, display name, title or an alias has it (``names``: document_id, source, display_name, title, aliases)."""
    words = sharded.select("shard_id", F.explode(T.search_tokens(F.col("text"), SHARD_STOP_WORDS)).alias("token"))
    counts = words.groupBy("shard_id", "token").agg((WEIGHTS["text"] * F.count(F.lit(1))).cast("bigint").alias("n"))
    if names is None:
        return counts
    told = [F.struct(F.col(c).alias("said"), F.lit(WEIGHTS[c]).alias("w")) for c in ("source", "display_name", "title")]
    others = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.struct(x.alias("said"), F.lit(WEIGHTS["alias"]).alias("w")))
    fields = names.select("document_id", F.explode(F.concat(F.array(*told), others)).alias("f")).filter("f.said IS NOT NULL")
    weighed = fields.select("document_id", F.col("f.w").alias("w"), F.explode(T.search_tokens(F.col("f.said"), SHARD_STOP_WORDS)).alias("token"))
    held = sharded.select("shard_id", "document_id").distinct()
    boosts = held.join(weighed, "document_id").groupBy("shard_id", "token").agg(F.sum("w").cast("bigint").alias("n"))
    return counts.unionByName(boosts).groupBy("shard_id", "token").agg(F.sum("n").alias("n"))


#: Bits of a shard's filter of words, and of its filter of stretches of three characters.
FILTER_BITS = 32_768


def _word_bit(word: str) -> int:
    return zlib.crc32(word.encode()) % FILTER_BITS


def _gram_bits(text: str) -> np.ndarray:
    """The bits of a text's stretches of three characters: their code points, multiplied and cut."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    packed = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return (packed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64)  # 15 bits: FILTER_BITS


def gram_filters(sharded: DataFrame) -> DataFrame:
    """``shard_id, word_bits, gram_bits``: bitmaps of the words and of the trigrams that a shard's texts hold, 4 KB each.

    Tasks fill the bitmaps of the shards whose rows they read, one shard at a time, and Spark unites those of a shard; no word or trigram is a row.
    """
    body = sharded.select("shard_id", T.normalize_search_text(F.col("text")).alias("body"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, flags = None, np.zeros((2, FILTER_BITS), bool)
        told = lambda: pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.array([np.packbits(f, bitorder="little").tobytes()], pa.binary()) for f in flags)], ["shard_id", "word_bits", "gram_bits"])
        for batch in blocks.stretches(batches):
            bodies = batch.column("body")
            words = pc.split_pattern_regex(bodies, blocks.WORDS)
            coded = pc.list_flatten(words).dictionary_encode()
            bits = np.array([_word_bit(w) if w else -1 for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
            for name, text, start, end in zip(batch.column("shard_id").to_pylist(), bodies.to_pylist(), np.r_[0, ends[:-1]], ends):
                if name != shard:
                    if shard is not None:
                        yield told()
                    shard, flags = name, np.zeros((2, FILTER_BITS), bool)
                mine = bits[start:end]
                flags[0, mine[mine >= 0]] = True
                flags[1, _gram_bits(text or "")] = True
        if shard is not None:
            yield told()

    filled = body.mapInArrow(fill, "shard_id string, word_bits binary, gram_bits binary")
    return filled.groupBy("shard_id").agg(F.bitmap_or_agg("word_bits").alias("word_bits"), F.bitmap_or_agg("gram_bits").alias("gram_bits"))


def manifest(sharded: DataFrame, keywords: int = KEYWORDS, names: DataFrame | None = None) -> DataFrame:
    """A row per shard: bytes, chunks, documents, content hash, its sources and its heaviest tokens (:func:`keyword_postings`; ties by token)."""
    rows = sharded.groupBy("owner", "shard_id").agg(
        F.sum(F.octet_length("text")).cast("bigint").alias("byte_length"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_distinct("document_id").alias("document_count"),
        F.bit_xor(F.xxhash64("document_id", "page_number", "text")).alias("content_hash"),
    )
    order = Window.partitionBy("shard_id").orderBy(F.col("n").desc(), "token")
    top = keyword_postings(sharded, names).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keywords)
    listed = top.groupBy("shard_id").agg(F.sort_array(F.collect_list(F.struct("r", "token"))).alias("k"))
    made = rows.join(listed, "shard_id", "left").select("*", F.coalesce(F.col("k.token"), F.array().cast("array<string>")).alias("keywords")).drop("k")
    if names is None:
        return made
    sources = sharded.select("shard_id", "document_id").distinct().join(names.select("document_id", "source"), "document_id")
    return made.join(sources.groupBy("shard_id").agg(F.sort_array(F.collect_set("source")).alias("sources")), "shard_id", "left")


def offsets(shards: DataFrame) -> DataFrame:
    """Manifest rows with each shard's running start in its workspace."""
    before = Window.partitionBy("owner").orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("byte_offset", F.coalesce(F.sum("byte_length").over(before), F.lit(0)))


def layout_faults(shards: DataFrame) -> DataFrame:
    """Manifest rows whose offset isn't the end of the one before, or whose number isn't the next."""
    order = Window.partitionBy("owner").orderBy("shard_id")
    end = F.lag(F.col("byte_offset") + F.col("byte_length"), 1, 0).over(order)
    number = F.substring_index("shard_id", ":", -1).cast("bigint")
    told = shards.withColumn("expected", end).withColumn("number", F.row_number().over(order) - 1)
    return told.filter((F.col("expected") != F.col("byte_offset")) | (F.col("number") != number))


def totals(sharded: DataFrame) -> DataFrame:
    """One row: documents, pages, chunks and bytes of a snapshot."""
    pages = sharded.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("text")).alias("b"))
    return pages.agg(
        F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("chunks"), F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bytes"),
    )


def centroids(vectors: DataFrame) -> DataFrame:
    """``shard_id, provider, dimensions, scale, codes``: the quantised unit mean of each shard's largest group of vectors.

    Groups are those of one provider and length (``shard_id, provider, vector``); of equal ones the first by name. Sums are by
    dimension and taken map-side; they are rounded to nine places, so that their order doesn't matter.
    """
    rows = vectors.withColumn("dimensions", F.size("vector")).filter("dimensions > 0")
    groups = rows.groupBy("shard_id", "provider", "dimensions").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("shard_id").orderBy(F.col("n").desc(), "provider", "dimensions")
    largest = groups.withColumn("r", F.row_number().over(first)).filter("r = 1").select("shard_id", "provider", "dimensions")
    cells = rows.join(largest, ["shard_id", "provider", "dimensions"]).select("shard_id", "provider", "dimensions", F.posexplode("vector").alias("at", "x"))
    means = cells.groupBy("shard_id", "provider", "dimensions", "at").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    whole = means.groupBy("shard_id", "provider", "dimensions").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("mean"))
    return whole.select("shard_id", "provider", "dimensions", V.quantize(F.col("mean")).alias("q")).select("shard_id", "provider", "dimensions", "q.scale", "q.codes")


def write(sharded: DataFrame, path: str, buckets: int = BUCKETS, names: DataFrame | None = None, vectors: DataFrame | None = None) -> None:
    """Chunks in ``buckets`` folders, each sorted by shard, documents, the manifest and the layout.

    The manifest has a row per shard: offsets, keywords (of ``names`` too, see :func:`keyword_postings`), sources, filters of words and
    trigrams, and the centroid of the shard's ``vectors`` (chunk_id, provider, vector). The layout is one row: folders and totals.
    """
    bucket = F.pmod(F.xxhash64("shard_id"), F.lit(buckets)).cast("int")
    placed = sharded.withColumn("bucket", bucket)
    placed.repartition("bucket").sortWithinPartitions("bucket", "shard_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/chunks")
    spark = sharded.sparkSession
    written = spark.read.parquet(f"{path}/chunks")
    made = manifest(written, names=names).join(gram_filters(written), "shard_id", "left")
    if vectors is not None:
        means = centroids(vectors.join(written.select("chunk_id", "shard_id"), "chunk_id"))
        made = made.join(means.select("shard_id", F.struct("provider", "dimensions", "scale", "codes").alias("centroid")), "shard_id", "left")
    offsets(made).write.mode("overwrite").parquet(f"{path}/manifest")
    catalog = written.groupBy("document_id", "owner").agg(F.count_distinct("page_number").alias("pages"), F.count(F.lit(1)).alias("chunks"))
    catalog.write.mode("overwrite").parquet(f"{path}/documents")
    totals(written).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``documents, pages, chunks, bytes`` of a snapshot and the number of its folders, ``buckets``."""
    return spark.read.parquet(f"{path}/layout")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, owner, pages, chunks`` of a snapshot, without reading its chunks."""
    return spark.read.parquet(f"{path}/documents")


def reconstruct(rows: DataFrame) -> DataFrame:
    """``owner, document_id, pages, chunks`` of documents from the rows of all their shards (with ``chunk_index, total_pages, raw_text``).

    A page comes once, by number, however many rows carry its text (null where another row does; of unlike texts the least stays); a chunk
    comes once at its index. A row without ``chunk_index`` brings its page alone.
    """
    keys = ["owner", "document_id"]
    told = F.when(F.col("raw_text").isNotNull(), F.struct("total_pages", "raw_text"))
    pages = rows.groupBy(*keys, "page_number").agg(F.min(told).alias("t"))
    pages = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page_number", "t.total_pages", "t.raw_text"))).alias("pages"))
    chunks = rows.filter("chunk_index IS NOT NULL").groupBy(*keys, "chunk_index").agg(F.min(F.struct("page_number", "text")).alias("c"))
    chunks = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "c.page_number", "c.text"))).alias("chunks"))
    return pages.join(chunks, keys, "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(chunks.schema["chunks"].dataType)))


def load_shards(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The chunks of the wanted shards (``shard_id``), or of all; folders without any are skipped at run time."""
    chunks = spark.read.parquet(f"{path}/chunks")
    if wanted is None:
        return chunks.drop("bucket")
    if "bucket" not in wanted.columns:
        wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("shard_id"), F.lit(layout(spark, path).first()["buckets"])).cast("int"))
    return chunks.join(wanted.select("shard_id", "bucket").distinct(), ["bucket", "shard_id"], "left_semi").drop("bucket")


def shard_faults(spark: SparkSession, path: str) -> DataFrame:
    """``shard_id, fault`` of shards whose bytes, chunks or content aren't those of the manifest, or that are missing."""
    now = load_shards(spark, path).groupBy("shard_id").agg(
        F.sum(F.octet_length("text")).cast("bigint").alias("now_bytes"), F.count(F.lit(1)).alias("now_chunks"),
        F.bit_xor(F.xxhash64("document_id", "page_number", "text")).alias("now_hash"),
    )
    met = spark.read.parquet(f"{path}/manifest").join(now, "shard_id", "left")
    fault = (
        F.when(F.col("now_chunks").isNull(), "missing")
        .when(F.col("now_chunks") != F.col("chunk_count"), "chunk_count")
        .when(F.col("now_bytes") != F.col("byte_length"), "byte_length")
        .when(F.col("now_hash") != F.col("content_hash"), "content_hash")
    )
    return met.select("shard_id", fault.alias("fault")).filter("fault IS NOT NULL")


def rank_shards(shards: DataFrame, queries: DataFrame, means: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """``query_id, shard_id, score, rank``: 0.72 x the share of the query's tokens among the shard's keywords, 0.28 x the cosine
    of its centroid (:func:`centroids`) and the query's vector of that provider (``query_id, provider, query_vector``); ties by number."""
    from paperloom.operators import retrieval

    tokens = T.search_tokens(F.col("query"), SHARD_STOP_WORDS)
    asked = queries.select("query_id", F.size(tokens).alias("total"), F.explode(tokens).alias("token"))
    held = shards.select("shard_id", F.explode("keywords").alias("token"))
    if "sources" in shards.columns:  # the names of a shard's sources count as keywords
        named = shards.select("shard_id", F.explode("sources").alias("s")).select("shard_id", F.explode(T.search_tokens(F.col("s"), SHARD_STOP_WORDS)).alias("token"))
        held = held.unionByName(named).distinct()
    parts = held.join(retrieval.small(asked), "token").groupBy("query_id", "shard_id").agg((SHARD_COVERAGE * F.count(F.lit(1)) / F.first("total")).alias("score"))
    if means is not None and query_vectors is not None:
        told = means.select("shard_id", "provider", V.dequantize(F.struct("scale", "codes")).alias("mean")).join(retrieval.small(query_vectors), "provider")
        near = told.select("query_id", "shard_id", (SHARD_COSINE * F.greatest(F.lit(0.0), V.cosine(F.col("mean"), F.col("query_vector")))).alias("score"))
        parts = parts.unionByName(near.filter("score > 0")).groupBy("query_id", "shard_id").agg(F.sum("score").alias("score"))
    parts = parts.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "shard_id")
    return parts.withColumn("rank", F.row_number().over(order))


def centroids_of(shards: DataFrame) -> DataFrame | None:
    """The centroids that a manifest holds, as :func:`centroids` gives them; None if it has none."""
    if "centroid" not in shards.columns:
        return None
    return shards.filter("centroid IS NOT NULL").select("shard_id", "centroid.*")


def _set_bits(wanted: list[int]):
    """Which of the wanted bits a bitmap has, as a column function."""
    at = np.array(wanted, np.int64)

    @F.pandas_udf("array<int>")
    def held(maps: pd.Series) -> pd.Series:
        return maps.map(lambda m: at[np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")[at] == 1].tolist(), na_action="ignore")

    return held


def shards_for_quotes(shards: DataFrame, quotes: DataFrame, keys: int = 3) -> DataFrame:
    """``query_id, shard_id``: the shards whose filters hold the ``keys`` longest inner words of a quote, or trigrams of it if it has two words or less.

    No shard that holds a quote is left out; one that doesn't passes with the chance that other words have set the same bits.
    Only bits that some quote asks for are read from the filters, and meet the quotes by an equi join. Quotes of less than
    three characters ask for every shard, in a row without ``query_id``.
    """
    from paperloom.operators import retrieval

    @F.pandas_udf("array<struct<kind:string,bit:int>>")
    def bits_of(needles: pd.Series) -> pd.Series:
        out = []
        for needle, words in zip(needles, pc.split_pattern_regex(pa.array(needles, pa.string()), blocks.WORDS).to_pylist()):
            inner = sorted(dict.fromkeys([w for w in words if w][1:-1]), key=len, reverse=True)[:keys]
            bits = [("word_bits", _word_bit(w)) for w in inner] or [("gram_bits", int(b)) for b in _gram_bits(needle)]
            out.append([{"kind": k, "bit": b} for k, b in dict.fromkeys(bits)])
        return pd.Series(out)

    normal = quotes.select("query_id", T.normalize_search_text(F.col("query")).alias("needle")).filter("needle <> ''")
    asked = kept(normal.select("query_id", bits_of("needle").alias("bits")), "quote-bits")
    parts = []
    for kind in ("word_bits", "gram_bits"):
        mine = asked.filter(F.size("bits") > 0).filter(F.col("bits")[0]["kind"] == kind)
        wanted = sorted(r["bit"] for r in mine.select(F.explode("bits.bit").alias("bit")).distinct().collect())  # FILTER_BITS at most
        if not wanted:
            continue
        have = shards.select("shard_id", F.explode(_set_bits(wanted)(F.col(kind))).alias("bit"))
        bits = mine.select("query_id", F.size("bits").alias("n"), F.explode("bits.bit").alias("bit"))
        met = have.join(retrieval.small(bits), "bit").groupBy("query_id", "shard_id", "n").agg(F.count(F.lit(1)).alias("c"))
        parts.append(met.filter("c = n").select("query_id", "shard_id"))
    if not parts or not asked.filter(F.size("bits") == 0).isEmpty():
        parts.append(shards.select(F.lit(None).cast(dict(quotes.dtypes)["query_id"]).alias("query_id"), "shard_id").filter(F.lit(not asked.isEmpty())))
    return functools.reduce(DataFrame.unionByName, parts)


def find_quotes(spark: SparkSession, path: str, quotes: DataFrame) -> DataFrame:
    """``query_id, document_id, page_number``: the first page of the snapshot, in order, that holds a quote; shards whose filters rule every quote out aren't read."""
    from paperloom.operators import retrieval

    wanted = kept(shards_for_quotes(spark.read.parquet(f"{path}/manifest"), quotes).select("shard_id").distinct(), "quote-shards")
    return retrieval.exact_quotes(_pages(load_shards(spark, path, wanted)), quotes)


def _pages(chunks: DataFrame) -> DataFrame:
    """``document_id, page_number, raw_text``: each page's chunks in order."""
    place = "chunk_index" if "chunk_index" in chunks.columns else "chunk_id"
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "text"))), lambda c: c["text"]), "\n")  # a page's chunks
    return chunks.groupBy("document_id", "page_number").agg(joined.alias("raw_text"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 8, least: float = 0.12, per_document: int = 4, vectors: DataFrame | None = None, means: DataFrame | None = None, query_vectors: DataFrame | None = None, exhaustive: bool = False) -> DataFrame:
    """Top chunks of each query from its best shards alone: three at first, two more while its best score is weak, nine at most (all if ``exhaustive``).

    Scores: 0.42 x coverage, 0.85 if the chunk holds the query, 0.5 x its cosine where ``vectors(chunk_id, provider, vector)`` and
    ``query_vectors`` have one. Shards meet queries by joins; a round is one Spark job.
    """
    from paperloom.operators import retrieval

    most = (1 << 31) - 1 if exhaustive else MOST_READS
    buckets = layout(spark, path).first()["buckets"]
    shards = spark.read.parquet(f"{path}/manifest")
    ranked = rank_shards(shards, queries, means, query_vectors).filter(F.col("rank") <= most)
    ranked = kept(ranked.withColumn("bucket", F.pmod(F.xxhash64("shard_id"), F.lit(buckets)).cast("int")), "ranked")
    asked, found, depth = queries, None, 0
    while depth < most:
        low, depth = depth, most if exhaustive else min(most, depth + (MORE_READS if depth else FIRST_READS))
        chosen = ranked.join(asked.select("query_id"), "query_id", "left_semi").filter((F.col("rank") > low) & (F.col("rank") <= depth))
        chosen = kept(chosen.select("query_id", "shard_id", "bucket"), "chosen")
        if not exhaustive and chosen.isEmpty():
            break
        # a shard that holds none of a query's keywords isn't ranked for it, but may hold its words
        part = load_shards(spark, path) if exhaustive else kept(load_shards(spark, path, chosen), "shards")
        scored = [
            retrieval.coverage_scores(part, asked).select("query_id", "chunk_id", (CHUNK_COVERAGE * F.col("coverage")).alias("score")),
            retrieval.contains_pairs(part, asked).select("query_id", "chunk_id", F.lit(CHUNK_EXACT).alias("score")),
        ]
        if vectors is not None and query_vectors is not None:
            near = retrieval.semantic_scores(vectors.join(part.select("chunk_id"), "chunk_id", "left_semi"), query_vectors.join(asked.select("query_id"), "query_id", "left_semi"))
            scored.append(near.select("query_id", "chunk_id", (CHUNK_COSINE * F.greatest(F.lit(0.0), F.col("cosine"))).alias("score")))
        summed = functools.reduce(DataFrame.unionByName, scored).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score")).filter(F.col("score") >= least)
        told = summed.join(part.select("chunk_id", "document_id", "shard_id"), "chunk_id")
        told = told if exhaustive else told.join(chosen.select("query_id", "shard_id"), ["query_id", "shard_id"])
        told = kept(told.select("query_id", "chunk_id", "document_id", "score"), "scored")
        found = told if found is None else found.unionByName(told)
        good = found.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= WEAK)
        asked = asked.join(good.select("query_id"), "query_id", "left_anti")
        if exhaustive or asked.isEmpty():
            break
    if found is None:
        return spark.createDataFrame([], "query_id bigint, chunk_id bigint, document_id bigint, score double, rank int")
    per = Window.partitionBy("query_id", "document_id").orderBy(F.col("score").desc(), "chunk_id")
    capped = found.withColumn("d", F.row_number().over(per)).filter(F.col("d") <= per_document).drop("d")
    return retrieval.top_k(capped, "score", k)


class SnapshotProvider:
    """A snapshot as a source of retrieval beside the local pool: load, search, quotes and pages, each a DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        return catalog(self.spark, self.path)

    def search(self, queries: DataFrame, k: int = 8, **options) -> DataFrame:
        return search(self.spark, self.path, queries, k, **options)

    def pages(self) -> DataFrame:
        """``document_id, page_number, raw_text`` of all pages."""
        return _pages(load_shards(self.spark, self.path))

    def lookup_quotes(self, quotes: DataFrame) -> DataFrame:
        return find_quotes(self.spark, self.path, quotes)


def read_proof(observations: DataFrame) -> DataFrame:
    """Per snapshot: accesses, distinct shards, hits, misses, bytes; network bytes are null if any miss wasn't measured."""
    miss = ~F.col("cache_hit")
    measured = F.when(miss & F.col("network_bytes").isNotNull(), F.greatest(F.col("network_bytes"), F.lit(0)))
    complete = F.count_if(miss) == F.count(measured)
    return observations.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("accesses"),
        F.count_distinct("shard_id").alias("unique_shards"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(miss).alias("cache_misses"),
        F.sum("shard_bytes").alias("bytes_requested"),
        F.when(complete, F.coalesce(F.sum(measured), F.lit(0))).alias("network_bytes"),
    )

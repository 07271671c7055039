"""Functions and operators of the retrieval library on small tables: golden values, brute force and invariants."""

import datetime as dt
import glob
import json
import os
import pickle
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from paperloom.functions import intents
from paperloom.functions import records as R
from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import answers, blocks, canonical, ingest, retrieval, tables
from paperloom.plans import catalog
from paperloom.session import kept
from paperloom.sources import inventory, package, snapshot, versions
from paperloom.sources.versions import ConflictError, VersionedCorpus
from paperloom.streaming import streams

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_and_tokens(spark):
    assert one(spark, T.normalize_search_text(F.lit("  “Xin  CHÀO”\n‘b’ "))) == "\"xin chào\" 'b'"
    assert one(spark, T.search_tokens(F.lit("The Đường và For trong a x1 É"))) == ["đuong", "va", "x1"]
    assert one(spark, T.normalize_hex(F.lit("0XAB"))) == "ab"


def test_quality(spark):
    assert one(spark, T.text_quality(F.lit("too short"))) == 0
    good = "This paragraph has many different readable words, and it goes on for long enough to be trusted by the rule we apply here today."
    assert one(spark, T.is_useful(F.lit(good))) and not one(spark, T.is_useful(F.lit("□□ " * 60)))


def test_quotes_and_excerpts(spark):
    assert one(spark, T.longest_quote(F.lit("find “a longer quotation here” or 'shorter one'"))) == "a longer quotation here"
    assert one(spark, T.longest_quote(F.lit("nothing 'small'"))) is None
    text = "x " * 300 + "needle in the text " + "y " * 300
    got = one(spark, T.excerpt_around(F.lit(text), F.lit("needle in")))
    assert "needle in" in got and len(got) <= 420


def brute_chunks_hold(text, parts, size):
    assert all(len(p) <= size and p == p.strip() and p for p in parts)
    words = set(text.split())
    assert all(w in " ".join(parts) for w in words if len(w) < size // 2)


@pytest.mark.parametrize("size,overlap", [(120, 20), (800, 120), (1200, 180)])
def test_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", " ", "one", "z" * 310, "A. B! C? D", "para one\n \npara two"] + [
        " ".join("w" * rng.randint(1, 12) + rng.choice(["", "", ".", ".\n\n"]) for _ in range(rng.randint(1, 600))) for _ in range(12)
    ]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", ingest.chunk_text(F.col("t"), size, overlap).alias("c"))
    for t, c in df.collect():
        brute_chunks_hold(t or "", c, size)
        assert bool(c) == bool((t or "").strip())


def test_sniff(spark):
    cases = {
        b"%PDF-1.7": "PDF", b"\x89PNG\r\n\x1a\n": "PNG", b"\xff\xd8\xff\xe0": "JPEG", b"GIF89a": "GIF", b"RIFF1234WEBP": "WEBP", b"\0\0\0 ftypisom": "MP4 VIDEO",
        b"\0\0\0 ftypavif": "AVIF/HEIF", b"\0\0\0 ftypqt  ": "ISO MEDIA", b"PK\x03\x04": "ZIP/OFFICE", b"\0\1\2\3" * 50: "BINARY", b' {"a": 1}': "JSON", b"[1": "JSON",
        b'{"format": "kb-package"}': "PACKAGE", b"<!DOCTYPE  html>": "HTML", b"<html lang=x>": "HTML", b"<?xml version=1?>": "XML", b"plain": "TEXT", b"": "TEXT",
    }
    rows = spark.createDataFrame([(bytearray(k),) for k in cases], "b binary").select("b", R.sniff(F.col("b")).alias("s")).collect()
    assert {bytes(r["b"]): r["s"]["format"] for r in rows} == cases


def test_timestamps_and_keys(spark):
    for raw, want in {"1700000000": 1700000000 * 10**6, "1700000000123": 1700000000123000, "1700000000123456": 1700000000123456, "2023-11-14T22:13:20Z": 1700000000 * 10**6, "0": None, "-5": None, "soon": None}.items():
        assert one(spark, R.parse_timestamp_micros(F.lit(raw))) == want, raw
    assert one(spark, R.parse_workspace_key(F.lit("mainnet:0xAB"))).asDict() == {"network": "mainnet", "owner": "0xab"}
    assert one(spark, R.parse_workspace_key(F.lit("0xAB"))).asDict() == {"network": "testnet", "owner": "0xab"}
    assert one(spark, R.content_identity(F.lit("1:2:public:v1:x"))) == "1:2:public" and one(spark, R.content_identity(F.lit("1:2"))) == ""


def test_citations_and_counts(spark):
    assert one(spark, R.citation_ids(F.lit("a [S1, s02] b [S2] S9 [xS3 S4x] [S10]"))) == ["S1", "S2", "S10"]
    assert one(spark, answers.count_facts(F.lit("**12** files, ba tệp, v2 3.5 files, ten fileset"), ["files?", "tệp"])) == [3, 12]
    check = lambda a, offered: one(spark, answers.answer_contract(F.lit(a), F.array(*map(F.lit, offered)).cast("array<string>"), F.array(F.lit("Report.pdf")), F.array(F.lit(2)).cast("array<bigint>"), ["files?"], ["system prompt"]))
    assert check("my System Prompt says", ["S1"]) == "leak"
    assert check("report", ["S1"]) == "missing_citation" and check("report [S3]", ["S1"]) == "unknown_citation"
    assert check("it [S1]", ["S1"]) == "missing_exact_fact" and check("report: 5 files [S1]", ["S1"]) == "invalid_count_fact" and check("report: two files [S1]", ["S1"]) == "valid"


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (3.0, -4.0, 0.0)])
    assert one(spark, V.cosine(v, v)) == pytest.approx(1) and one(spark, V.cosine(v, F.array(F.lit(1.0)))) == 0
    back = one(spark, V.dequantize(V.quantize(v)))
    assert back == pytest.approx([0.6, -0.8, 0], abs=0.01)


def brute_span(query, page):
    best = None
    for a in range(len(page)):
        for b in range(a + 1, min(len(page), a + 2 * len(query)) + 1):
            span = page[a:b]
            d = list(range(len(span) + 1))
            for i, q in enumerate(query, 1):
                e = [i]
                for j, s in enumerate(span, 1):
                    e.append(min(d[j - 1] + (q != s), e[-1] + 1, d[j] + 1))
                d = e
            best = d[-1] if best is None else min(best, d[-1])
    return best


def test_span_distance():
    rng = random.Random(1)
    for _ in range(60):
        page = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        query = [rng.choice("abcd") for _ in range(rng.randint(3, 6))]
        got = retrieval.span_distance(np.array([ord(x) for x in query]), np.array([ord(x) for x in page]))
        assert got[0] == min(brute_span(query, page), len(query))


def test_span_ends_hold_the_distance():
    """The span that is named is as near as stated, and no other begins and ends nearer."""
    rng = random.Random(5)
    for _ in range(60):
        page = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        query = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        edits, start, end = retrieval.span_distance(np.array([ord(x) for x in query]), np.array([ord(x) for x in page]))
        table = np.arange(end - start + 1)
        for i, q in enumerate(query, 1):
            row = [i]
            for j, x in enumerate(page[start:end], 1):
                row.append(min(table[j - 1] + (q != x), row[-1] + 1, table[j] + 1))
            table = np.array(row)
        assert edits == table[-1] and 0 <= start <= end <= len(page)


def test_tolerant_terms_are_all_within_one_edit(spark):
    rng = random.Random(7)
    vocabulary = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(2, 5))) for _ in range(150)})
    asked = vocabulary[::9] + ["abab", "éa"]
    tokens = spark.createDataFrame([(0, vocabulary), (1, vocabulary[:5])], "chunk_id long, tokens array<string>")
    terms = spark.createDataFrame(list(enumerate(asked)), "query_id long, token string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    got = {(r["query_id"], r["token"]) for r in retrieval.tolerant_terms(tokens, terms).collect()}
    assert got == {(i, w) for i, a in enumerate(asked) for w in vocabulary if edits(a, w) <= 1}


def test_small_checks_bytes(spark):
    wide = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 100_000).alias("vector"))
    assert "broadcast" not in retrieval.small(wide)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in retrieval.small(wide.limit(3))._jdf.queryExecution().logical().toString().lower()


def test_quote_lookup(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(99, 1, texts[4])], "document_id long, page_number int, raw_text string")
    exact, parts = " ".join(texts[4].split()[10:30]), texts[9].split()[5:25]
    parts[3], parts[11] = "zzz", "yyy"
    quotes = spark.createDataFrame([(1, exact), (2, " ".join(parts)), (3, "no such thing anywhere"), (4, "ab"), (5, "")], "query_id long, query string")
    got = {r["query_id"]: (r["document_id"], r["method"], round(r["score"], 3)) for r in retrieval.quote_lookup(pages, quotes).collect()}
    assert got == {1: (4, "exact", 1.0), 2: (9, "fuzzy", 0.9)}


def test_selection_caps(spark):
    chunks = spark.createDataFrame([(i, i % 3, i % 2, f"unique{i} words{i} here{i}" if i else "unique3 words3 here3") for i in range(30)], "chunk_id long, document_id long, page_number int, text string")
    scored = chunks.select(F.lit(1).alias("query_id"), "chunk_id", (1 - F.col("chunk_id") / 100).alias("score"))
    got = retrieval.select_diverse(scored, chunks).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 9)) and [r["chunk_id"] for r in got][0] == 0 and 3 not in [r["chunk_id"] for r in got]
    for d in range(3):
        mine = [r for r in got if r["document_id"] == d]
        assert len(mine) <= 4 and all(sum(r["page_number"] == p for r in mine) <= 2 for p in (0, 1))


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_shards_equal_a_fold(spark, partitions):
    """Shards over many ranges of pages against a walk of all pages in order, with large and small pages."""
    rng = random.Random(partitions)
    rows = [(o, d, p, "x" * (rng.choice([1, 50, 900, 5000, 30000, 90000]) + rng.randrange(50))) for o, n in (("a", 120), ("b", 3), ("c", 1)) for d in range(n) for p in range(rng.randint(1, 2))]
    docs = spark.createDataFrame([(o, hash(o) % 97 * 1000 + d, p, t) for o, d, p, t in rows], "owner string, document_id long, page_number int, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r["document_id"], r["page_number"]): r["shard_id"] for r in snapshot.assign_shards(docs, snapshot.LEAST_BYTES).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    owner = None
    for r in sorted(docs.collect()):
        if r["owner"] != owner:
            owner, held, shard = r["owner"], 0, 0
        if held and held + len(r["text"]) > snapshot.LEAST_BYTES:
            held, shard = 0, shard + 1
        held += len(r["text"])
        assert got[r["document_id"], r["page_number"]] == f"{owner}:{shard:08d}"


def test_snapshot_search_with_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(i, "o", 1, i, f"words about topic{i} " + "filler " * 3000) for i in range(30)], "document_id long, owner string, page_number int, chunk_id long, text string")
    path = f"file://{tmp_path}/snap"
    sharded = snapshot.assign_shards(rows, snapshot.LEAST_BYTES)
    snapshot.write(sharded, path)
    assert snapshot.shard_faults(spark, path).isEmpty()
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(30)]
    vectors = spark.createDataFrame([(i, "p", unit(i)) for i in range(30)], "chunk_id long, provider string, vector array<double>")
    means = snapshot.centroids(vectors.join(sharded.select("chunk_id", "shard_id"), "chunk_id"))
    asked = spark.createDataFrame([(1, "topic7"), (2, "nothing known")], "query_id long, query string")
    told = spark.createDataFrame([(2, "p", unit(21))], "query_id long, provider string, query_vector array<double>")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in snapshot.search(spark, path, asked, vectors=vectors, means=means, query_vectors=told).collect()}
    assert got[1, 7] >= 1.27 - 1e-6 and got[2, 21] == 0.5
    every = snapshot.search(spark, path, asked, exhaustive=True, vectors=vectors, means=means, query_vectors=told).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in every} >= {(1, 7), (2, 21)}
    one = snapshot.SnapshotProvider(spark, path)
    assert one.load().count() == 30 and one.lookup_quotes(asked.filter("query_id = 1")).first()["document_id"] == 7
    spark.read.parquet(f"{path}/manifest").withColumn("chunk_count", F.col("chunk_count") + 1).write.parquet(f"{path}/bad/manifest")
    spark.read.parquet(f"{path}/chunks").write.partitionBy("bucket").parquet(f"{path}/bad/chunks")
    assert {r["fault"] for r in snapshot.shard_faults(spark, f"{path}/bad").collect()} == {"chunk_count"}


# Questions and the intents that they have.
ROUTES = [
    ("What is retrieval-augmented generation?", "general"), ("Blob storage là gì?", "general"), ("Explain how PDF compression works.", "general"), ("What is an image embedding?", "general"),
    ("Summarize the causes of World War II.", "general"), ("Tell me a story about a fox.", "general"), ("Who wrote Hamlet?", "general"), ("“Knowledge is power” nghĩa là gì?", "general"),
    ("Can you help me brainstorm?", "general"), ("What can an AI assistant do?", "general"), ("Summarize my indexed documents.", "summarize_study_guide"),
    ("Tóm tắt tài liệu đã nạp của tôi.", "summarize_study_guide"), ("What does my PDF say about quorum?", "document_semantic"), ("Trong tài liệu của tôi, nó được mô tả thế nào?", "document_semantic"),
    ("Find the exact quote “Every answer needs evidence” in my document.", "exact_quote"), ("Which page contains “Every answer needs evidence”?", "page_lookup"),
    ("How many pages does my book have?", "metadata"), ("How many blobs does my wallet have?", "inventory"), ("Tell me story number 12 from my book.", "story_lookup"), ("Describe cover-art.webp.", "image"),
    ("Describe the image I uploaded.", "image"), ("List the documents in my knowledge base.", "inventory"), ("What is my wallet address?", "wallet"), ("What is my OneUSD balance?", "wallet"),
    ("What does it mean?", "general"), ("Nó mô tả điều gì?", "general"),
    ("Which wallet is connected?", "wallet"), ("Kiểm tra số blob hiện tại của ví tôi", "inventory"), ("Tôi có sách Cổ học tinh hoa không?", "inventory"), ("Inspect indexed image blobs", "image"),
    ("Which visible details support that description?", "image"), ("Open package.json and identify the main libraries used.", "document_semantic"), ("Explain what a wallet address is.", "general"),
]
# End of fixed values.


def test_intents(spark):
    rows = spark.createDataFrame(ROUTES + [(unicodedata.normalize("NFD", q), i) for q, i in ROUTES], "question string, want string")
    got = rows.select("question", "want", intents.classify(F.col("question"), "apt|aptos|oneusd").alias("got"), intents.document_scoped(F.col("want")).alias("scoped")).collect()
    assert [(r["question"], r["got"]) for r in got if r["got"] != r["want"]] == []
    assert all(r["scoped"] == (r["want"] not in ("general", "wallet")) for r in got)
    assert one(spark, intents.inventory_detail(F.lit("List all files"))) == "all" and one(spark, intents.inventory_detail(F.lit("Which files?"))) == "sample"


def test_file_inventory(spark, tmp_path):
    for name, n in (("a.txt", 5), ("b.bin", 3), ("empty", 0)):
        (tmp_path / name).write_bytes(b"x" * n)
    got = {r["name"]: r["size"] for r in inventory.file_inventory(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": 5, "b.bin": 3}


def test_snapshot_round_trip_and_pruned_search(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text <> ''")
    rows = docs.select(F.lit("all").alias("owner"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.lit(1).alias("page_number"), "text")
    sharded = snapshot.assign_shards(rows, snapshot.LEAST_BYTES)
    path = f"file://{tmp_path}/snap"
    snapshot.write(sharded, path)
    back = spark.read.parquet(f"{path}/chunks")
    assert back.select("document_id", "text").exceptAll(rows.select("document_id", "text")).isEmpty() and back.count() == rows.count()
    shards = spark.read.parquet(f"{path}/manifest")
    assert shards.count() > 9 and snapshot.layout_faults(snapshot.offsets(shards)).isEmpty()
    assert not snapshot.layout_faults(snapshot.offsets(shards).withColumn("byte_offset", F.col("byte_offset") + 1)).isEmpty()
    some = rows.filter("chunk_id IN (250, 700)").select(F.col("chunk_id").alias("query_id"), F.substring("text", 1, 300).alias("query"))
    got = snapshot.search(spark, path, some).collect()
    assert {r["query_id"] for r in got if r["rank"] == 1} == {250, 700} and all(r["score"] >= 0.12 for r in got)


def test_packages_with_vectors_and_stories(spark, tmp_path):
    """Vectors and stories survive the file; a faulty package is refused alone; an import is all or nothing and drops what isn't eligible."""
    listed = spark.createDataFrame([(1, "a", "t", "indexed"), (2, "b", "t", "indexed"), (3, "c", "t", "failed")], "document_id long, source string, title string, status string")
    pages = spark.createDataFrame([(1, 2, 2, "y"), (1, 1, 2, "x"), (2, 1, 1, None)], "document_id long, page_number int, total_pages int, raw_text string")
    chunks = spark.createDataFrame([(1, 1, 2, "y"), (1, 0, 1, "x"), (2, 0, 1, "z")], "document_id long, chunk_index int, page_number int, text string")
    stories = spark.createDataFrame([(1, 1.5, "s", 2)], "document_id long, number double, title string, page_number int")
    vectors = spark.createDataFrame([(1, 0, [0.5, -1.0])], "document_id long, chunk_index int, vector array<double>")
    out = package.export(listed, pages, chunks, stories, vectors)
    package.write(out, f"file://{tmp_path}/p")
    back = package.read(spark, f"file://{tmp_path}/p")
    a, b = back.orderBy("source").collect()
    assert a["pages"][0]["raw_text"] == "x" and a["chunks"][0]["vector"] == [0.5, -1.0] and a["chunks"][1]["vector"] is None and a["stories"][0]["number"] == 1.5 and b["stories"] == []
    got = package.import_tables(back, "me", eligible=listed.filter("source = 'a'"))
    assert [(r["source"], r["vector_status"]) for r in got["manifest"].collect()] == [("a", "ready")] and got["stories"].count() == 1 and got["chunks"].count() == 2
    assert package.import_tables(back.limit(0), "me")["manifest"].isEmpty()
    many = back.withColumn("package_id", F.lit(1)).unionByName(back.withColumn("package_id", F.lit(2)).withColumn("pages", F.array().cast(package.PAGES)))
    package.write(many, f"file://{tmp_path}/many")
    assert {r["package_id"] for r in package.accepted(package.read(spark, f"file://{tmp_path}/many")).collect()} == {1}
    with pytest.raises(ValueError, match="repeated_source"):
        package.import_tables(back.unionByName(back), "me")
    long = back.withColumn("title", F.lit("t")).withColumn("pages", F.transform("pages", lambda p: p.withField("raw_text", F.repeat(F.lit("x"), package.MAX_CHARACTERS // 2 + 1))))
    assert {r["rule"] for r in package.violations(long).collect()} == {"too_many_characters"}


def test_documents_from_overlapping_shards(spark):
    """Pages of several rows and repeated shards come once, a null text gives way, a row without a chunk brings its page alone."""
    rows = spark.createDataFrame(
        [("o", 1, 2, 2, "y", 1, "y"), ("o", 1, 1, 2, None, 0, "x"), ("o", 1, 1, 2, "x", 2, "w"), ("o", 2, 1, 1, "", None, "")],
        "owner string, document_id long, page_number int, total_pages int, raw_text string, chunk_index int, text string",
    )
    one, two = snapshot.reconstruct(rows.unionByName(rows)).orderBy("document_id").collect()
    assert [(p["page_number"], p["raw_text"]) for p in one["pages"]] == [(1, "x"), (2, "y")] and [c["text"] for c in one["chunks"]] == ["x", "y", "w"]
    assert len(two["pages"]) == 1 and two["chunks"] == [] and snapshot.reconstruct(rows.limit(0)).isEmpty()


def test_package_round_trip(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    listed = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("d"), "doc_id").alias("source"), F.lit("t").alias("title"), F.lit("indexed").alias("status"))
    out = package.export(listed, ingest.pages(docs), ingest.paragraph_chunks(docs))
    package.write(out, f"file://{tmp_path}/p")
    back = package.read(spark, f"file://{tmp_path}/p")
    assert sorted(map(str, back.collect())) == sorted(map(str, out.collect()))
    assert package.violations(back).isEmpty()
    bad = back.withColumn("pages", F.concat("pages", "pages")).unionByName(back.limit(1))
    assert {r["rule"] for r in package.violations(bad).collect()} == {"repeated_page", "repeated_source"}


def four_tables(spark, sources, text, owner="o"):
    rows = spark.createDataFrame([(s, owner, f"{text} {s}") for s in sources], "source string, owner string, text string")
    return {"manifest": rows.select("source", "owner"), "pages": rows.select("source", "text"), "chunks": rows.select("source", "text", F.lit(0).alias("chunk_index")), "stories": rows.filter("source > 'd'").select("source", F.lit(text).alias("title"))}


def seen(corpus, state=None):
    return {t: sorted(map(tuple, corpus.read(t, state).collect())) for t in ("manifest", "pages", "chunks", "stories")}


def test_corpus_commits_are_whole(spark, tmp_path):
    corpus = VersionedCorpus(spark, f"file://{tmp_path}/c", buckets=4)
    assert corpus.read("pages") is None
    assert corpus.replace(four_tables(spark, "abcdef", "old")) == 1
    before, state = seen(corpus), corpus.state()
    assert len(before["pages"]) == 6 and len(before["stories"]) == 2

    class Dies(VersionedCorpus):
        """Writes its data, then dies before, or while, it writes the pointer."""

        def _commit(self, made, before):
            if self.torn:
                (tmp_path / "c/commits/000000000002.json").write_text('{"commit": 2, "fol')
            raise RuntimeError("lost")

    for torn in (False, True):
        dying = Dies(spark, f"file://{tmp_path}/c")
        dying.torn = torn
        with pytest.raises(RuntimeError):
            dying.replace(four_tables(spark, "abz", "new"))
        assert seen(corpus) == before
    assert corpus.replace(four_tables(spark, "aez", "new")) == 3  # past the torn pointer
    after = seen(corpus)
    assert after["pages"] == sorted([(s, f"{'new' if s in 'aez' else 'old'} {s}") for s in "abcdefz"]) and after["stories"] == [("e", "new"), ("f", "old"), ("z", "new")]
    assert seen(corpus, state) == before  # a reader that began earlier goes on with its state
    assert corpus.clean(keep=1) >= 1 and seen(corpus) == after
    assert VersionedCorpus(spark, f"file://{tmp_path}/c", buckets=99).state()["buckets"] == 4


def test_corpus_refuses_conflicts(spark, tmp_path):
    corpus = VersionedCorpus(spark, f"file://{tmp_path}/c", buckets=4)
    corpus.replace(four_tables(spark, "ab", "old"))
    before = seen(corpus)
    twice = {t: df.unionByName(df) for t, df in four_tables(spark, "a", "new").items()}
    orphan = four_tables(spark, "a", "new") | {"pages": four_tables(spark, "q", "new")["pages"]}
    for bad in (four_tables(spark, "bc", "new", "somebody else"), twice, orphan):
        with pytest.raises(ConflictError):
            corpus.replace(bad)
    state = corpus.state()
    corpus.replace(four_tables(spark, "c", "new"))
    with pytest.raises(ConflictError):
        corpus._commit(dict(state), state)  # one that began before the last
    assert corpus.replace(four_tables(spark, "d", "x"), stream="s", batch=4) == 3
    assert corpus.replace(four_tables(spark, "d", "y"), stream="s", batch=4) == 3 == corpus.replace(four_tables(spark, "d", "y"), stream="s", batch=2)
    assert corpus.read("pages").filter("source = 'd'").first()["text"] == "x d"
    assert before["manifest"] == [("a", "o"), ("b", "o")]


def test_rate_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts").orderBy("ts").coalesce(1)
    source = f"file://{tmp_path}/in"
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    with streams.rocksdb_state(spark):
        q = streams.rate_stream(stream, limit=2, seconds=3600).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["event_id"], r["allowed"]) for r in spark.table("rates").collect()}
    want = {(r["event"], r["allowed"]) for r in tables.rate_decisions(events, limit=2, seconds=3600).collect()}
    assert got == want and len({a for _, a in want}) == 2


def test_ingest_stream_is_idempotent(spark, tmp_path):
    """Batches delivered again, revisions that are known, documents that change and texts that are refused."""
    schema = "doc_id long, text string, source string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{name}")
    text = "One sentence here. Another sentence there. " * 60
    put("a", [(1, text, "o"), (2, "12 - THE STORY OF OLD\nA text of its own.", "o"), (3, "", "p"), (5, "x\n" * 3100, "p")])
    put("b", [(1, text, "o"), (4, text + "more", "p"), (4, "A less text.", "p")])
    corpus, rejected = VersionedCorpus(spark, f"file://{tmp_path}/corpus", buckets=4), f"file://{tmp_path}/rejected"
    lines = lambda pages: ingest.paragraph_chunks(pages.select(F.col("document_id").alias("doc_id"), F.col("raw_text").alias("text")))
    run = lambda cut=None, name="ingest", state="c": streams.ingest_stream(spark, f"file://{tmp_path}/in/*", schema, corpus, f"file://{tmp_path}/{state}", rejected, name, cut, files=1).awaitTermination(180)
    run(lines)
    got, commits = seen(corpus), corpus.state()["commit"]
    assert {r["source"]: r["chunk_count"] for r in corpus.read("manifest").collect()} == {"doc_1": 1, "doc_2": 2, "doc_4": 1}
    assert {r["document_id"]: r["raw_text"] for r in corpus.read("pages").collect()} == {1: text, 2: "12 - THE STORY OF OLD\nA text of its own.", 4: text + "more"}
    assert corpus.read("stories").first()["number"] == 12
    assert {(r["document_id"], r["reason"]) for r in spark.read.parquet(rejected).collect()} == {(3, "no_text"), (5, "too_many_chunks")}
    # the same batch again, as after a failure between the commit and the checkpoint
    docs = spark.read.schema(schema).parquet(f"file://{tmp_path}/in/a")
    streams.ingest_batch(corpus, docs.withColumn("text", F.lit("other")), "ingest", 0, rejected, lines)
    assert seen(corpus) == got and corpus.state()["commit"] == commits
    # another checkpoint: all revisions are known
    run(lines, "again", "d")
    assert seen(corpus) == got
    put("c", [(2, "A text that has changed.", "o")])
    run(lines)
    assert corpus.read("pages").filter("document_id = 2").first()["raw_text"] == "A text that has changed." and corpus.read("stories").isEmpty()


def test_revision_and_freshness_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "o"), ("a", "1", "o"), ("a", "2", "o"), ("b", "1", "p")], "source string, revision string, owner string").withColumn("observed_at", F.timestamp_seconds(F.lit(1700000000)))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    for name, df, mode, n in (("revs", streams.new_revisions(stream), "append", 3), ("fresh", streams.freshness(stream), "update", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n


def test_partition_counts_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).persist()
    chunks = docs.filter("text <> ''").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    asked = docs.limit(5).select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 80).alias("query"))
    seen = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str(sorted(map(str, retrieval.select_diverse(retrieval.hybrid_scores(chunks, asked), chunks).withColumn("score", F.round("score", 8)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_entry_and_catalog(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    key = lambda r: repr(sorted((k, plain(v)) for k, v in r.items()))
    assert sorted(names) == sorted(df.columns) and sorted(map(key, got)) == sorted(map(key, want))


def test_containment_of_queries_of_any_length(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab c,é") for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", "🎈 ab", None]
    asked = sorted({t[i : i + n] for t in texts[:30] if t for n in (1, 2, 3, 4, 9, 25) for i in (0, 3) if t[i : i + n]}) + ["zz", "no such words here", "", "🎈"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = retrieval.contains_pairs(chunks, queries)
    normal = lambda t: " ".join(t.lower().split())
    want = {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if t and normal(q) and normal(q) in normal(t)}
    assert {tuple(r) for r in found.select("query_id", "chunk_id").collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_fuzzy(pages, quote):
    """The best page by distances over whole pages."""
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    q, best = [w for w in split(quote) if len(w) > 1], None
    if len(q) < 3:
        return None
    for d, t in pages:
        p = split(t)
        if not p:
            continue
        numbers = {w: i for i, w in enumerate(dict.fromkeys(q + p))}
        edits, start, end = retrieval.span_distance(np.array([numbers[w] for w in q]), np.array([numbers[w] for w in p]))
        score = 1 - edits / max(len(q), end - start) if end > start else 0
        if score >= 0.82 and (best is None or score > best[1] + 1e-12):
            best = (d, score)
    return best


def test_fuzzy_quotes_equal_whole_pages(spark):
    """Quotes of 3 to 200 tokens with as many edits as they may have or one more, on pages up to 60,000 tokens."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 10, 50, 400, 400, 60_000)]
    texts.append(texts[3][:200] + texts[4][:200])
    quotes = []
    for n in (3, 4, 5, 7, 10, 14, 30, 64, 65, 200):
        for more in (-2, -1, 0, 1):
            source = rng.choice([t for t in texts if len(t) >= n])
            at = rng.randrange(len(source) - n + 1)
            q = source[at : at + n]
            for _ in range(max(0, int(n * 0.18 / 0.82 + 1e-9) + more)):
                i, kind = rng.randrange(len(q)), rng.choice("rid")
                q[i : i + 1] = {"r": ["other"], "i": [q[i], "more"], "d": []}[kind] if len(q) > 1 else q
            quotes.append(" ".join(q))
    pages = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, 1, t) for i, t in pages], "document_id long, page_number int, raw_text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "query_id long, query string")
    got = {r["query_id"]: (r["document_id"], round(r["score"], 9)) for r in retrieval.fuzzy_quotes(table, asked).collect()}
    want = {i: (b[0], round(b[1], 9)) for i, q in enumerate(quotes) if (b := brute_fuzzy(pages, q))}
    assert got == want and len(want) > 8


def test_selection_equals_a_walk_of_everything(spark):
    rng = random.Random(31)
    rows = [(i, rng.randrange(6), rng.randrange(2), " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(3))) for i in range(120)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, page_number int, text string")
    scores = [(q, i, round(rng.random(), 1)) for q in range(5) for i in range(120) if rng.random() < (0.1 if q == 4 else 0.9)]
    scored = spark.createDataFrame(scores, "query_id long, chunk_id long, score double")
    want = []
    for q in range(5):
        mine = sorted(((s, c) for k, c, s in scores if k == q), key=lambda x: (-x[0], x[1]))
        floor, chosen = max(0.16, 0.22 * mine[0][0]), []
        for s, c in mine:
            _, d, p, text = rows[c]
            same = [x for x in chosen if x[0] == d]
            words = set(text.split())
            if s < floor or len(chosen) >= 8 or len(same) >= 4 or sum(x[1] == p for x in same) >= 2 or any(len(words & w) / len(words | w) >= 0.86 for _, _, w in same):
                continue
            chosen.append((d, p, words))
            want.append((q, c, d, p, s, len(chosen)))
    for batch in (1, 3, 8, 500):
        got = retrieval.select_diverse(scored, chunks, batch=batch)
        assert sorted(map(tuple, got.select("query_id", "chunk_id", "document_id", "page_number", "score", "rank").collect())) == want


def test_quotes_go_on_to_the_snapshot(spark, tmp_path):
    words = [f"word{i}" for i in range(200_000)]
    rng = random.Random(41)
    texts = [" ".join(rng.choice(words) for _ in range(3000)) for _ in range(40)]
    rows = spark.createDataFrame([("o", i, 10 * i, 1, t) for i, t in enumerate(texts)], "owner string, document_id long, chunk_id long, page_number int, text string")
    path = f"file://{tmp_path}/snap"
    snapshot.write(snapshot.assign_shards(rows, snapshot.LEAST_BYTES), path, buckets=16)
    kept = snapshot.SnapshotProvider(spark, path)
    local = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts[:10])], "document_id long, page_number int, raw_text string")
    cut = lambda i, a, n: texts[i].split()[a : a + n]
    misquoted = cut(4, 100, 30)
    misquoted[7] = misquoted[19] = "another"
    asked = [(1, " ".join(cut(3, 50, 20))), (2, " ".join(misquoted)), (3, " ".join(cut(33, 700, 12))), (4, "nothing like this exists there"), (5, " ".join(cut(25, 10, 2)))]
    quotes = spark.createDataFrame(asked, "query_id long, query string")
    got = {r["query_id"]: (r["document_id"], r["method"]) for r in retrieval.quote_lookup(local, quotes, kept).collect()}
    assert got == {1: (3, "exact"), 2: (4, "fuzzy"), 3: (33, "snapshot"), 5: (25, "snapshot")}
    shards = spark.read.parquet(f"{path}/manifest")
    passed = {(r["query_id"], r["shard_id"]) for r in snapshot.shards_for_quotes(shards, quotes).collect()}
    held = {(q, r["shard_id"]) for r in spark.read.parquet(f"{path}/chunks").collect() for q, t in asked if t in r["text"]}
    assert held <= passed and len([q for q, _ in passed if q != 5]) < len(held) + 5 < shards.count()  # quote 5 has common trigrams alone
    one = snapshot.load_shards(spark, path, shards.filter("shard_id = 'o:00000003'"))
    assert files_read(one) == 1 < len(glob.glob(f"{tmp_path}/snap/chunks/*/*.parquet"))




def files_read(df):
    """How many files the scan of a table in buckets opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return max(found)


def test_merged_search_tolerates_a_lost_pool(spark):
    columns = "query_id long, chunk_id long, document_id long, page_number int, content_hash string, text string, score double"
    local = spark.createDataFrame([(1, 1, 1, 1, "a", "x", 0.5), (1, 2, 2, 1, "b", "y", 0.4)], columns)
    remote = spark.createDataFrame([(1, 11, 1, 1, "c", "z", 0.9), (1, 12, 9, 1, "b", "y", 0.8), (1, 13, 9, 1, "d", "w", 0.45)], columns)
    served = local.select("document_id")
    got = retrieval.merged_search(local, lambda: remote, served)
    assert [(r["chunk_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(12, 1), (1, 2), (13, 3)]
    lost = retrieval.merged_search(local, lambda: spark.read.parquet("file:///no/such/snapshot"), served)
    assert [r["chunk_id"] for r in lost.orderBy("rank").collect()] == [1, 2]


def test_snapshot_stores_its_layout(spark, tmp_path):
    docs = spark.createDataFrame([(i, "o", 1, i, f"words about topic{i} " + "filler " * 3000) for i in range(20)], "document_id long, owner string, page_number int, chunk_id long, text string")
    sharded = snapshot.assign_shards(docs, snapshot.LEAST_BYTES)
    names = docs.select("document_id", F.concat(F.lit("file"), "document_id").alias("source"), F.lit(None).cast("string").alias("display_name"), F.concat(F.lit("The filler of "), "document_id").alias("title"), F.array(F.lit("alias one"), F.lit("aliastwo")).alias("aliases"))
    unit = docs.select("chunk_id", F.lit("p").alias("provider"), F.array(F.lit(1.0), F.col("chunk_id").cast("double")).alias("vector"))
    path = f"file://{tmp_path}/snap"
    snapshot.write(sharded, path, buckets=16, names=names, vectors=unit)
    assert snapshot.layout(spark, path).first().asDict() == {"documents": 20, "pages": 20, "chunks": 20, "bytes": docs.agg(F.sum(F.octet_length("text"))).first()[0], "buckets": 16}
    asked = spark.createDataFrame([(1, "topic7"), (2, "file13")], "query_id long, query string")
    got = {r["query_id"]: r["document_id"] for r in snapshot.search(spark, path, asked, k=1).collect()}
    assert got[1] == 7
    shards = spark.read.parquet(f"{path}/manifest")
    first = shards.orderBy("shard_id").first()
    of_first = [r["document_id"] for r in sharded.filter("shard_id = 'o:00000000'").collect()]
    assert first["byte_offset"] == 0 and sorted(first["sources"]) == sorted(f"file{i}" for i in of_first)
    assert first["keywords"][0] == "filler" and set(first["keywords"][1:]) >= {"aliastwo", f"file{of_first[0]}"}
    ranked = snapshot.rank_shards(shards, asked).filter("query_id = 2 AND rank = 1").first()
    assert ranked["shard_id"] == sharded.filter("document_id = 13").first()["shard_id"]
    assert snapshot.centroids_of(shards).count() == shards.count()


def test_timers_for_late_expired_and_lost_keys(spark, tmp_path):
    """Silences and rate windows over batches that come out of order, against a computation over all rows."""
    minute = 60_000_000
    batches = [
        [("a", 0), ("b", 1), ("a", 9), ("c", 3)],  # minutes; a is silent between 0 and 9
        [("a", 4), ("b", 14), ("d", 10)],  # a at 4 comes late, but within the delay: only 4 to 9 would be short of 5
        [("a", 30), ("b", 31)],
        [("late", 2), ("a", 62)],  # behind the watermark: dropped
    ]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(o, t * minute) for o, t in rows], "owner string, micros long")
        made.select("owner", F.timestamp_micros("micros").alias("observed_at")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        os.utime(glob.glob(f"{tmp_path}/in/{i}/*.parquet")[0], (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("owner string, observed_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    with streams.rocksdb_state(spark):
        streams.silences(stream, minutes=5, delay="10 minutes").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r["owner"], r["last_micros"] // minute) for r in spark.read.schema("owner string, last_micros long").parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", 9), ("a", 30), ("b", 1), ("b", 14), ("b", 31), ("c", 3), ("d", 10)]  # 62 is not over yet; 4 to 9 is no silence


def test_rate_windows_expire(spark, tmp_path):
    second = 1_000_000
    batches = [[(1, 7, 1000), (2, 7, 1001), (3, 7, 1002)], [(4, 8, 1500)], [(9, 9, 1500)], [(5, 7, 1501), (6, 7, 1502), (7, 7, 1503), (8, 7, 1005)]]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(e, u, t * second) for e, u, t in rows], "event_id long, user_id long, micros long")
        made.select("event_id", "user_id", F.timestamp_micros("micros").alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        os.utime(glob.glob(f"{tmp_path}/in/{i}/*.parquet")[0], (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    with streams.rocksdb_state(spark):
        query = streams.rate_stream(stream, limit=2, seconds=60, delay="1 minute").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(240)
    got = {r["event_id"]: r["allowed"] for r in spark.read.schema("event_id long, allowed boolean").parquet(f"file://{tmp_path}/out").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 9: True, 5: True, 6: True, 7: False}  # event 8 is behind the watermark of the batch before
    left = spark.read.format("statestore").option("path", f"file://{tmp_path}/state").option("stateVarName", "window").load()
    assert {r["key"]["user_id"] for r in left.collect()} <= {7, 8, 9}  # of the first window of user 7 nothing is left
    assert all(r["value"]["ends"] > 1500 * second for r in left.collect())


def brute_canonical(value):
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        x = float(value)
        if x == 0:
            return "0"
        digits, _, power = repr(abs(x)).partition("e")
        whole, _, part = digits.partition(".")
        part = "" if part == "0" else part
        every, point = (whole + part).lstrip("0"), len(whole) + int(power or 0)
        point -= len(whole + part) - len((whole + part).lstrip("0"))
        every = every.rstrip("0")
        if len(every) <= point <= 21:
            said = every + "0" * (point - len(every))
        elif 0 < point <= 21:
            said = every[:point] + "." + every[point:]
        elif -6 < point <= 0:
            said = "0." + "0" * -point + every
        else:
            said = every[0] + ("." + every[1:] if len(every) > 1 else "") + "e" + ("+" if point > 0 else "-") + str(abs(point - 1))
        return ("-" if x < 0 else "") + said
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(brute_canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
    return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + brute_canonical(value[k]) for k in keys) + "}"


def test_canonical_json(spark):
    rng = random.Random(17)
    words = ["a", "B", "ab", "é", "", 'q"\\', "line\n\t\x01\x1f/", "\U0001f388", "￿", "0", "10", "9"]
    numbers = [0, -0.0, 1, -7, 10, 100.0, 1.5, 0.1, 1e-6, 1.25e-7, 1e21, 1.5e20, 123456789.123, 2**53, 1e300, 5e-324, -2.5e-10, 12345678901234567890]

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return [rng.choice(words), rng.choice(numbers), rng.choice([True, False]), None][kind]
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(13))]
        return {k: value(depth - 1) for k in rng.sample(words, rng.randrange(6))}

    values = [value(4) for _ in range(120)] + [[], {}, [[]], {"a": {}}, numbers]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for v in values]
    bad = ["{", "nope", '{"a": 1, "a": 2}', '[1, {"x": [1e999]}]', "", None]
    rows = spark.createDataFrame(list(enumerate(texts + bad)), "k long, body string")
    got = dict(map(tuple, canonical.canonical_json(rows, "k", "body").collect()))
    assert len(got) == len(texts) + len(bad)
    assert [(t, got[i]) for i, (v, t) in enumerate(zip(values, texts)) if got[i] != brute_canonical(v)] == []
    assert [got[len(texts) + i] for i in range(len(bad))] == [None] * len(bad)


def test_intents_know_every_coin(spark):
    for coin in ("apt", "aptos", "oneusd"):
        asked = spark.createDataFrame([(f"What is my {coin} wallet address?",), (f"What is my {coin} balance?",)], "q string")
        assert [r[0] for r in asked.select(intents.classify(F.col("q"), "apt|aptos|oneusd")).collect()] == ["wallet", "wallet"]


def _both(spark, duck_sql, name, tmp_path, **tables):
    """A query's rows over small tables, and those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    got = __import__("__spark_entry__").queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({duck_sql[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_titles_map_letters_one_to_one(spark, tmp_path):
    sql = __import__("__spark_entry__").oracle_sql()
    rows = [(1, "ßen ist da\nzwei", "de", "src1", 1), (4, "ΟΔΟΣ ΑΣ ist", "el", "src1", 1), (7, "Ünter İstanbul da", "tr", "src2", 1)]
    got, want = _both(spark, sql, "p06_infer_title", tmp_path, documents=(rows, DOCUMENTS))
    assert got == want and got[0][1] == "ẞen ist da"


def test_long_packages_only_name_documents(spark, tmp_path, monkeypatch):
    from paperloom.sources import package

    monkeypatch.setattr(package, "MAX_CHARACTERS", 10)
    sql = __import__("__spark_entry__").oracle_sql()
    rows = [(c, t, "user", "some words") for c in (1, 2) for t in range(3 + 2 * c)]
    got, want = _both(spark, sql, "s05_package_violations", tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert got == want and len(got) == 2


def test_latest_artifact_with_large_keys(spark, tmp_path):
    sql = __import__("__spark_entry__").oracle_sql()
    day = dt.datetime
    rows = [(1, 7, day(2000, 1, 10)), (5_000_002, 7, day(2000, 1, 8)), (2, 8, day(2000, 1, 2)), (4, 8, day(2000, 1, 1))]
    got, want = _both(spark, sql, "s09_latest_artifact", tmp_path, orders=(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp"))
    assert got == want == [(7, 5_000_002), (8, 2)]


def test_signed_counts_that_cancel_out(spark, tmp_path):
    import zlib

    sql = __import__("__spark_entry__").oracle_sql()
    seen = {}
    for i in range(5000):
        h = zlib.crc32(f"w{i}".encode())
        seen.setdefault(h % 256, {})[h >> 16 & 1] = f"w{i}"
    pair = next(" ".join(v.values()) for v in seen.values() if len(v) == 2)
    rows = [(1, pair, "en", "s", 1), (2, " \n", "en", "s", 1), (3, " ", "en", "s", 1), (4, None, "en", "s", 1), (5, "some words", "en", "s", 1)]
    got, want = _both(spark, sql, "x01_embed", tmp_path, documents=(rows, DOCUMENTS))
    assert got == want == [(1, 1.0), (2, 0.0), (3, 1.0), (4, 0.0), (5, 1.0)]


def test_silences_at_the_very_hour(spark, tmp_path):
    """A silence of an hour is none, one of a microsecond more is; no state is kept in Python."""
    sql = __import__("__spark_entry__").oracle_sql()
    at = lambda s, us=0: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s, microseconds=us)
    rows = [(1, at(0), 1), (2, at(3600), 1), (3, at(7200, 1), 1), (4, at(90, 5), 2), (5, at(3690, 6), 2), (6, at(50), 3), (7, at(86400), 9), (8, at(86400 - 3900), 4), (9, at(86400 - 3900, 1), 5), (10, at(50), None)]
    got, want = _both(spark, sql, "t04_silences", tmp_path, events=(rows, "event_id long, ts timestamp, user_id long"))
    assert got == [x for x in want if x[0] is not None] or got == want


def test_blocks_equal_joins(spark, monkeypatch):
    """Scores of few queries by matrix products are those of the joins, whatever the k best; more queries than a block."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(300)], "chunk_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(rng.choice(words) for _ in range(3))) for q in range(70)], "query_id long, query string")
    vectors = spark.createDataFrame([(i, [float(rng.randrange(4)) for _ in range(rng.choice([0, 3]))], i % 2) for i in range(60)], "chunk_id long, vector array<float>, provider int")
    asked = vectors.filter("chunk_id < 9").selectExpr("chunk_id AS query_id", "vector AS query_vector", "provider")
    run = lambda k: [
        sorted((q, c, round(x, 8)) for q, c, x in df.select("query_id", "chunk_id", F.col(df.columns[-1])).collect())
        for df in (retrieval.lexical_scores(chunks, queries, k=k), retrieval.coverage_scores(chunks, queries), retrieval.semantic_scores(vectors, asked, k=k), retrieval.contains_pairs(chunks, queries).withColumn("one", F.lit(1.0)))
    ]
    quick, some = run(None), run(2)
    monkeypatch.setattr(retrieval, "is_small", lambda df, rows=0: False)
    assert quick == run(None)
    for i in (0, 2):
        for q in {x[0] for x in quick[i]}:
            best = lambda rows: sorted((-x, c) for p, c, x in rows if p == q)[:2]  # noqa: B023, E731
            assert best(quick[i]) == best(some[i])


def test_exhaustive_search_reads_shards_without_a_keyword(spark, tmp_path):
    """A shard whose 96 keywords hold none of a query's words is read all the same."""
    common = " ".join(f"word{i:03d} word{i:03d}" for i in range(100))
    docs = spark.createDataFrame([(1, f"{common} rareone raretwo rarethree"), (2, "nothing here")], "chunk_id long, text string").selectExpr("'o' AS owner", "chunk_id AS document_id", "chunk_id", "1 AS page_number", "text")
    path = f"file://{tmp_path}/s"
    snapshot.write(snapshot.assign_shards(docs), path, buckets=4)
    found = snapshot.search(spark, path, spark.createDataFrame([(5, "rareone raretwo rarethree")], "query_id long, query string"), exhaustive=True)
    assert [(r["query_id"], r["chunk_id"]) for r in found.collect()] == [(5, 1)]


def test_filters_hold_every_word_and_trigram_without_a_row_for_each(spark):
    texts = [("a", "The Königin's  “café”\tof 𝒳y"), ("b", ""), ("a", "ab"), ("c", "x y")]
    made = snapshot.gram_filters(spark.createDataFrame(texts, "shard_id string, text string"))
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    bits = lambda m: set(np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")))
    got = {r["shard_id"]: (bits(r["word_bits"]), bits(r["gram_bits"])) for r in made.collect()}
    bodies = {"a": ['the königin\'s "café" of 𝒳y', "ab"], "b": [""], "c": ["x y"]}
    for shard, held in bodies.items():
        words = {w for b in held for w in re.split(r"[^\w]+", b) if w}
        grams = {b[i : i + 3] for b in held for i in range(len(b) - 2)}
        assert got[shard] == ({snapshot._word_bit(w) for w in words}, {int(snapshot._gram_bits(g)[0]) for g in grams})


def test_accents_and_white_space_are_folded_in_whole_texts(spark):
    text = "Été ́ a-́bc ẞ ΌΣΟΣ  ﻿the of\tİx ‘q’"
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = df.select(T.normalize_search_text(F.col("text")), T.search_tokens(F.col("text"))).collect()
    assert got[0][0] == "été ́ a-́bc ß όσος the of i̇x 'q'" and got[0][1] == ["ete", "bc", "οσος", "of", "ix"]
    assert [tuple(r) for r in got[1:]] == [(None, None), ("", [])]


def test_hybrid_parts_are_added_in_the_tasks(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta omega kappa sigma theta".split())
    chunks = spark.createDataFrame([(i, i // 2, 1, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(300)], "chunk_id long, document_id long, page_number int, text string")
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(5))) for q in range(70)] + [(70, "x"), (71, None)], "query_id long, query string")
    cosines = spark.createDataFrame([(q, i, rng.uniform(-1, 1)) for q in range(72) for i in range(305) if rng.random() < 0.1], "query_id long, chunk_id long, cosine double")
    titles = spark.createDataFrame([(7, "beta"), (9, "alpha beta"), (9, "no such title")], "document_id long, title string")

    def rows(df):
        return {(r["query_id"], r["chunk_id"]): (round(r["score"], 9), r["method"]) for r in df.collect()}

    best = lambda df: rows(retrieval.top_k(df.withColumn("score", F.round("score", 9)), "score", 4))
    quick = retrieval.hybrid_scores(chunks, asked, cosines, titles)
    all_, few = rows(quick), retrieval.hybrid_scores(chunks.repartition(3), asked, cosines, titles, k=4)
    assert few.count() < len(all_) / 3  # before, every chunk with a word of the query was a row
    over = rows(retrieval.hybrid_scores(chunks, asked, cosines, titles, least=0.3))
    top = best(few)
    monkeypatch.setattr(retrieval, "is_small", lambda df, rows=0: False)
    slow = retrieval.hybrid_scores(chunks, asked, cosines, titles)
    assert rows(slow) == all_ and best(slow) == top
    assert {k: v for k, v in over.items() if v[0] >= 0.3} == {k: v for k, v in all_.items() if v[0] >= 0.3} and len(over) < len(all_)


def test_stretches_are_bounded_in_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["x" * 1000] * 599 + ["y" * 50_000])], names=["chunk_id", "body"])
    parts = list(blocks.stretches(iter([batch]), rows=256, most=20_000))
    assert pa.Table.from_batches(parts).column("chunk_id").to_pylist() == list(range(600))
    assert all(p.nbytes <= 20_000 or p.num_rows == 1 for p in parts)


def test_best_chunks_find_once(spark):
    """What was found is computed once, however often the best chunks look at it."""
    seen_rows = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen_rows.add(1)
        return x

    found = spark.createDataFrame([(1, 7)], "query_id long, d long").coalesce(1).select("query_id", counted("d").alias("document_id"), F.lit(1).alias("page_number"))
    chunks = spark.createDataFrame([(7, 1, 0, "other words"), (7, 1, 1, "alpha beta gamma"), (8, 1, 0, "alpha beta")], "document_id long, page_number int, chunk_index int, text string")
    quotes = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    assert list(map(tuple, retrieval.best_chunks(found, chunks, quotes).collect())) == [(1, 7, 1, 1, True)]
    assert seen_rows.value == 1


def test_replaced_rows_are_written_where_they_are(spark, tmp_path, monkeypatch):
    """A commit neither shuffles texts nor writes them twice; what it refuses is deleted."""
    names = []
    monkeypatch.setattr(versions, "kept", lambda df, name: names.append(name) or kept(df, name))
    corpus = VersionedCorpus(spark, f"file://{tmp_path}/c", buckets=1)
    rows = {t: df.repartition(3) for t, df in four_tables(spark, "abcdefghijkl", "old").items()}
    corpus.replace(rows)
    assert len(glob.glob(f"{tmp_path}/c/data/*/pages/bucket=0/*.parquet")) == 3
    assert all(n in ("incoming-manifest", "incoming-sources") for n in names)
    before, folders = seen(corpus), len(os.listdir(tmp_path / "c/data"))
    with pytest.raises(ConflictError):
        corpus.replace(four_tables(spark, "ab", "new") | {"chunks": four_tables(spark, "c", "new")["chunks"]})  # c is in, but not of this commit
    assert seen(corpus) == before and len(os.listdir(tmp_path / "c/data")) == folders


def test_lines_of_each_equal_paragraph_chunks(spark):
    docs = spark.createDataFrame([(1, "a\n \nb\n\tc\n"), (2, ""), (3, None), (4, "\n\nx"), (5, "  y  \n\x0b\nz")], "doc_id long, text string")
    columns = ["document_id", "page_number", "position", "text", "chunk_index"]
    told, want = (sorted(map(tuple, f(docs).select(columns).collect())) for f in (ingest.lines_of_each, ingest.paragraph_chunks))
    assert told == want and len(told) == 7
    assert "Exchange" not in ingest.lines_of_each(docs)._jdf.queryExecution().executedPlan().toString()


def test_canonical_json_writes_a_level_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(canonical, "kept", lambda df, name: names.append(name) or kept(df, name))
    rows = spark.createDataFrame([(1, '{"b": "line\\n\\u0001\\t", "a": [1.0, {"c": "\\r"}]}')], "k long, body string")
    assert canonical.canonical_json(rows, "k", "body").first()["canonical"] == '{"a":[1,{"c":"\\r"}],"b":"line\\n\\u0001\\t"}'
    assert len(names) == 5  # four levels and the empty one below


def _scratch(monkeypatch):
    """The columns and rows of each scratch table that the scorers write from now on, by name."""
    seen, write = {}, retrieval.kept

    def noted(df, name):
        made = write(df, name)
        seen.setdefault(name, []).append((set(made.columns), made.count()))
        return made

    monkeypatch.setattr(retrieval, "kept", noted)
    return seen


def test_hybrid_keeps_no_texts_of_chunks(spark, monkeypatch):
    """Words within one edit, numbers, accents and marks, and queries without inner words score as by the joins; no scratch table has the texts or all their words."""
    rng = random.Random(17)
    base = "alpha beta gamma 1234 12345 straße été été of on x y naïve delta-omega".split()

    def word():
        w = rng.choice(base)
        return w if rng.random() < 0.6 else (lambda i: w[:i] + rng.choice(["", "z", "0"]) + w[i + rng.randrange(2) :])(rng.randrange(len(w)))

    texts = [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["", None, "the x and y the"]
    chunks = spark.createDataFrame([(i, i, 1, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, page_number int, text string")
    cut = [" ".join(t.split()[a : a + n]) for t in texts[:40] for a, n in ((0, 3), (1, 5), (0, 1))]
    asked = spark.createDataFrame(list(enumerate(cut + ["x and y", "é", "…", "", None, "on of the été", "1234 12345"])), "query_id long, query string")
    told = lambda df: {(r["query_id"], r["chunk_id"]): (round(r["score"], 8), r["method"]) for r in df.collect()}
    seen = _scratch(monkeypatch)
    quick = told(retrieval.hybrid_scores(chunks, asked))
    assert "indexed" in seen and not [n for n, tables in seen.items() if any(c & {"body", "tokens", "text"} for c, _ in tables)]
    monkeypatch.setattr(retrieval, "is_small", lambda df, rows=0: False)
    assert quick == told(retrieval.hybrid_scores(chunks, asked)) and len(quick) > 3000


def test_weights_are_sent_without_empty_cells():
    """What tasks get grows with the pairs of a query and a word, not with a block's queries for each word; the sums are the same."""
    rng = np.random.default_rng(3)
    rows = [(int(q), f"w{w}", float(x)) for q, w, x in zip(rng.integers(0, 130, 4000), range(4000), rng.random(4000))]
    weights = blocks.Weights(rows, 130)
    assert len(pickle.dumps(weights)) < 60 * len(rows)
    number = {w: i for i, w in enumerate(weights.words.to_pylist())}
    row, word, value = rng.integers(0, 9, 700), rng.choice(4000, 700, replace=False), rng.random(700)
    want = np.zeros((9, 130))
    for q, w, x in rows:
        for i in np.flatnonzero(word == number[w]):
            want[row[i], q] += value[i] * x
    assert np.allclose(np.hstack([x for _, x in weights.products(9, row, word, value)]), want)


def test_selection_reads_words_of_its_batches_alone(spark, monkeypatch):
    rng = random.Random(37)
    texts = [" ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(3)) for _ in range(200)]
    rows = [(i, rng.randrange(6), rng.randrange(2), t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, page_number int, text string")
    scores = [(q, i, round(rng.random(), 3)) for q in range(4) for i in range(200)]
    scored = spark.createDataFrame(scores, "query_id long, chunk_id long, score double")
    want = []
    for q in range(4):
        chosen = []
        mine = sorted((-s, c) for k, c, s in scores if k == q)
        for s, c in mine:
            _, d, p, text = rows[c]
            same, words = [x for x in chosen if x[0] == d], set(text.split())
            if -s < max(0.16, -0.22 * mine[0][0]) or len(chosen) >= 3 or len(same) >= 4 or sum(x[1] == p for x in same) >= 2 or any(len(words & w) / len(words | w) >= 0.86 for _, _, w in same):
                continue
            chosen.append((d, p, words))
            want.append((q, c, d, p, -s, len(chosen)))
    seen = _scratch(monkeypatch)
    walk = lambda: sorted(map(tuple, retrieval.select_diverse(scored, chunks, limit=3, batch=4).select("query_id", "chunk_id", "document_id", "page_number", "score", "rank").collect()))
    assert walk() == sorted(want)
    assert max(n for tables in seen.values() for c, n in tables if "tokens" in c) <= 4 * 3  # before, all candidates had theirs stored
    monkeypatch.setattr(retrieval, "is_small", lambda df, rows=0: False)
    assert walk() == sorted(want)


def test_a_failed_pool_does_not_pass_for_a_result(spark, monkeypatch, tmp_path):
    columns = "query_id long, chunk_id long, document_id long, page_number int, content_hash string, text string, score double"
    local = spark.createDataFrame([(1, 1, 1, 1, "a", "x", 0.5)], columns)
    served, gone = local.select("document_id"), lambda: spark.read.parquet("file:///no/such/snapshot")
    assert [r["complete"] for r in retrieval.merged_search(local, lambda: local, served).collect()] == [True]
    with pytest.warns(RuntimeWarning, match="local pool alone"):
        assert [r["complete"] for r in retrieval.merged_search(local, gone, served).collect()] == [False]
    os.makedirs(tmp_path / "torn")
    (tmp_path / "torn" / "part-0.parquet").write_bytes(b"not a table")
    torn = lambda: spark.read.schema(columns).parquet(f"file://{tmp_path}/torn")
    wrong = lambda: local.withColumn("score", F.raise_error(F.lit("a bug")).cast("double"))
    for failed, pool, options in ((wrong, local, {}), (torn, local, {}), (lambda: local.select("no_such_column"), local, {}), (gone, local.limit(0), {}), (gone, local, {"required": True})):
        with pytest.raises((PySparkException, Py4JJavaError)):
            retrieval.merged_search(pool, failed, served, **options)

    def lost(*_, **__):
        raise AnalysisException("[PATH_NOT_FOUND] Path does not exist: file:/gone.", errorClass="PATH_NOT_FOUND", messageParameters={"path": "file:/gone"})

    monkeypatch.setattr(snapshot, "search", lost)
    with pytest.raises(PySparkException):
        catalog.queries()["u01_r05_merged_search"](spark, "/root/testdata/sf0.001")

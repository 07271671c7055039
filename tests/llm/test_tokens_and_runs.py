"""Alignment, token counts and periodic runs against brute force, on small tables with nulls, empty texts, repeats and odd columns."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from paperloom.llm import align, queries, runs, token_counts
from paperloom.llm.tokens import encoder

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, row long, a string, n_bytes double, start string, body string, c long"
SF = "/root/testdata/sf0.001"

ODD = [
    "<|endoftext|> İ Σσς don't <|ENDOFTEXT|> <|startoftext|>x",
    " ",
    "   ",
    "\n",
    " \n x",
    "  two\t\tspaces \n\n end ",
    "é é \x00\x01\x7f a\x85b ΑΣ",
    "a ▁ b",
    "日本語のテキスト 中文 中文",
    "👩‍👩‍👧 <s> </s> <unk> <0x41>",
    "x" * 3000,
    "a\r\nb　d 'S 'LL we'RE 1234",
    "͸ and \U000323b0 aren't known",
]


def texts_of(sf=SF):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def table(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 9, "x", 0.5, "y", "z", 3) for i, t in rows], SCHEMA).repartition(3)


ROWS = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, ""), (None, "no id here"), (3, "repeated id"), (3, "repeated id"), (60, "the cat sat " * 9 + "down")]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- 11 ---


@functools.lru_cache
def libraries():
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    return a, b


@functools.lru_cache(None)
def brute_alignment(text):
    """Ids, groups and links of a text by listing all cuts."""
    a_library, b_library = libraries()
    letters = align.byte_level.read
    a = a_library.encode(" " + text, add_special_tokens=False).ids if text else []
    b = b_library.encode(text) if text else []
    a_bytes = [letters(a_library.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_library.id_to_piece(i)]]
    whole = (" " + text).encode() if text else b""
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], [], []
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    at = {e: i for i, e in enumerate(a_ends)}
    pairs = [(at[e], j) for j, e in enumerate(b_ends) if e in at]
    groups, x, y = [], 0, 0
    for i, j in pairs:
        groups.append((a[x : i + 1], b[y : j + 1]))
        x, y = i + 1, j + 1
    return a, b, groups, [(a[i], b[j]) for i, j in pairs]


def brute_counts(rows):
    aligned = [brute_alignment(t or "") for _, t in rows]
    counts = Counter(link for *_, links in aligned for link in links)
    most = defaultdict(int)
    for (_, b), c in counts.items():
        most[b] = max(most[b], c)
    out = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, aligned):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best, total = sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, total, hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return out


LINKS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ordered(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_alignment(spark, frequent):
    """By the table of frequent pairs alone, with a join of the rarer ones, and by the join alone."""
    rows = ROWS + texts_of()[:40]
    got = align.link_counts(table(spark, rows), BYTE, PIECE, frequent=frequent)
    assert got.columns == LINKS
    assert ordered(tuple(r[c] for c in LINKS) for r in rows_of(got)) == ordered(brute_counts(rows))


def test_alignment_query(spark):
    got = queries.queries()["op11_align"](spark, SF)
    assert ordered(tuple(r[c] for c in LINKS) for r in rows_of(got)) == ordered(brute_counts(texts_of()))


def test_alignment_of_nothing(spark):
    assert rows_of(align.link_counts(table(spark, []), BYTE, PIECE)) == []


def test_common_cuts():
    rng = np.random.default_rng(3)
    for n, m, size in [(1, 1, 5), (50, 60, 200), (400, 30, 1000), (30, 400, 1000), (500, 500, 100_000)]:
        for _ in range(20):
            a, b = (np.unique(np.r_[rng.integers(1, size, k), size]) for k in (n, m))
            got = align.common_cuts(a, b, np.array([0]), np.array([len(a)]))
            assert a[got].tolist() == np.intersect1d(a, b).tolist()


def test_text_without_cuts_in_between():
    """One group of many tokens on both sides."""
    a, b = np.r_[np.arange(2, 20_001, 2)], np.r_[np.arange(1, 20_000, 2), 20_000]
    assert align.common_cuts(a, b, np.array([0]), np.array([len(a)])).tolist() == [len(a) - 1]


def test_pieces_are_forgotten():
    coder, library = align.PieceEncoder(PIECE, memo_bytes=1), SentencePieceProcessor(model_file=PIECE)
    for texts in (ODD, ODD[::-1]):
        ids, ends = coder.encode([" " + t for t in texts])
        assert [ids[x:y].tolist() for x, y in zip([0, *ends], ends)] == [library.encode(t) for t in texts]


# --- 12 ---


def brute_tokens(rows):
    library = Tokenizer.from_file(WORD)
    n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    return ordered((i, len((t or "").encode()), c, c > 20) for (i, t), c in zip(rows, n))


def counted(df):
    return ordered((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(df))


def test_token_counts(spark, monkeypatch):
    rows = ROWS + [(70, "many words " * 200)]
    assert counted(token_counts.count_tokens(table(spark, rows), WORD, 20)) == brute_tokens(rows)
    empty = spark.sparkContext.broadcast({})
    assert counted(token_counts.count_tokens(table(spark, rows), WORD, 20, table=empty)) == brute_tokens(rows)
    assert counted(token_counts.count_tokens(table(spark, []), WORD, 20)) == []


def test_token_counts_query(spark):
    got = rows_of(queries.queries()["op12_token_counts"](spark, SF))
    library = Tokenizer.from_file(WORD)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts_of()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_frequent_table(spark):
    rows = [(i, "often often rare%d" % i) for i in range(30)]
    table_ = token_counts.frequent_lengths(table(spark, rows), WORD, entries=3)
    library = Tokenizer.from_file(WORD)
    assert set(table_) >= {"often", "rare"} and len(table_) == 3
    assert all(n == len(library.encode(p, add_special_tokens=False).ids) for p, n in table_.items())


def test_counting_in_pieces_and_with_a_small_cache(monkeypatch):
    library, counter = Tokenizer.from_file(WORD), token_counts.Counters(WORD)
    texts = [t for t in ODD if "͸" not in t] + ["Ünïcode wörds, é and <|endoftext|> more ́x " * 40]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(token_counts, "PIECE", 50)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(token_counts, "LONGEST", 5)
    assert counter.count(texts, {}).tolist() == want == counter.count(texts, {"and": 1}).tolist()
    counter.count(["qa qb qc qd"], {})
    assert set(counter.cache) == {"qa", "qb", "qc", "qd"}  # more would be over the bound, so it was begun anew


def test_every_code_point_is_split_as_the_library_does():
    """Those known to this Python; the others are given to the library."""
    counter = token_counts.Counters(WORD)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b " for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    want = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts, {}).tolist() == want


# --- 13 ---


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[x] == w[x - p] for x in range(s + p, s + size)) for p in range(1, q)):
                out.append((s, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text, planted):
    w = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if planted and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join("%d,%d,%d\n" % r for r in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


DIGEST = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic(rng):
    w = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(1, rng.choice([2, 5, 9])))]
        w += unit * rng.randint(1, 7)
        w += w[-len(unit) :][: rng.randint(0, len(unit))]
    return w


def test_runs_against_all_lags():
    rng = random.Random(11)
    for _ in range(400):
        texts = [periodic(rng) for _ in range(rng.randint(1, 4))]
        ends = np.cumsum([0, *map(len, texts)])
        symbols = np.array([1000 * i + ord(x) for i, w in enumerate(texts) for x in w], np.int64)
        for least, times in ((6, 4), (1, 3), (10, 5)):
            found = runs.find_runs(symbols, least, times)
            want = [(int(s + ends[i]), size, q) for i, w in enumerate(texts) for s, size, q in brute_runs(w, least, times)]
            assert list(zip(*(x.tolist() for x in found))) == want


def test_run_digests(spark):
    rng = random.Random(12)
    rows = ROWS + [(100 + i, " ".join(periodic(rng))) for i in range(150)] + [(400, "a b " * 30 + "\x0bB\x1fA b\x0c"), (401, "same " * 2000)]
    for planted in (None, queries.planted_run):
        got = runs.digest_runs(table(spark, rows), places=planted)
        assert got.columns == DIGEST
        assert ordered(tuple(r[c] for c in DIGEST) for r in rows_of(got)) == ordered(brute_digest(i, t, planted) for i, t in rows)
    assert rows_of(runs.digest_runs(table(spark, []))) == []


def test_runs_query(spark):
    got = queries.queries()["op13_runs"](spark, SF)
    want = [brute_digest(i, t, True) for i, t in texts_of()]
    assert ordered(tuple(r[c] for c in DIGEST) for r in rows_of(got)) == ordered(want)
    assert sum(n for _, n, *_ in want) > 0


def test_spans_and_collapsed_texts(spark):
    rows = [(1, "x y z  x y z\nx y z x y z x end"), (2, "no run"), (None, "a " * 6), (4, None)]
    spans = rows_of(runs.run_spans(table(spark, rows)))
    assert ordered(tuple(r.values()) for r in spans) == ordered([(1, 0, 13, 3), (None, 0, 6, 1)])
    kept = {r["doc_id"]: r["text"] for r in rows_of(runs.collapse(table(spark, rows)))}
    assert kept == {1: "x y z end", 2: "no run", None: "a", 4: ""}

"""The training-data operators against brute force, on small tables with nulls, empty texts, repeats and odd columns."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import brown_lm, chat, exact_dedup, fingerprints, mixing, packing, quality, queries, simhash, token_store, url_filter
from paperloom.llm.common import materialize, scratch_path
from paperloom.llm.tokens import Encoder, as_bytes, encoder

SCHEMA = "doc_id long, text string, source string, digest string, fp string, h long, rate double"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text[, source]) with columns whose names the operators use themselves."""
    full = [(*r, *[None] * (3 - len(r)), "x", "y", 7, 1.5) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def words(n, seed, vocabulary=200):
    rng = random.Random(seed)
    return " ".join(rng.choice([f"w{i}" for i in range(vocabulary)]) for _ in range(n))


ROWS = [
    (1, "Alpha beta.\nGamma delta", "a"),
    (2, "alpha BETA.\ngamma DELTA", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, "É é alpha", "b"),
    (6, "é é alpha", "b"),
    (7, words(3000, 1), "a"),
    (8, words(3000, 1).replace("w7 ", "w8 ", 1), "a"),
    (9, "x" * 5000, "c"),
    (9, "x" * 5000, "c"),
    (None, "no id", "c"),
    (11, "  two\t\tspaces \n\n end ", "c"),
    (12, "<|endoftext|> İ Σσς don't", "d"),
]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def lower(t):
    return (t or "").encode().lower()


def test_exact_dedup(spark):
    got = rows_of(exact_dedup.decide(table(spark, ROWS)))
    groups = defaultdict(list)
    for r in ROWS:
        groups[hashlib.sha256(lower(r[1])).digest()].append(r[0])
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[bytes(r["digest"])]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = rows_of(exact_dedup.survivors(table(spark, ROWS)))
    assert len(kept) == len(groups) and set(kept[0]) == {"doc_id", "text", "source", "digest", "fp", "h", "rate"}
    assert {r["doc_id"] for r in kept} == {2, 4, 5, 6, 7, 8, 9, None, 11, 12}
    assert rows_of(exact_dedup.decide(table(spark, []))) == [] == rows_of(exact_dedup.survivors(table(spark, [])))


def test_exact_dedup_index_persists(spark):
    path = scratch_path(spark, "index")
    exact_dedup.decide(table(spark, ROWS[:6]), exact_dedup.DigestIndex(spark, path))
    again = exact_dedup.DigestIndex(spark, path)
    assert again.entries().count() == 4
    got = {r["doc_id"]: r for r in rows_of(exact_dedup.decide(table(spark, [(20, "ALPHA beta.\ngamma delta"), (21, "fresh"), (22, "Fresh")]), again))}
    assert not got[20]["kept"] and got[20]["keep_id"] == 2
    assert got[22]["kept"] and not got[21]["kept"] and got[21]["keep_id"] == 22
    assert again.entries().count() == 5
    assert spark.table(again.table)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("partitions", [3, 16])
def test_exact_dedup_index_outlives_its_session(spark, partitions):
    """Reopened with no catalog entry and other shuffle settings, an index finds all that it holds."""
    path = scratch_path(spark, "index")
    docs = table(spark, [(i, f"text {i}") for i in range(300)])
    exact_dedup.decide(docs, exact_dedup.DigestIndex(spark, path, buckets=8)).count()
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).table}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 8 and again.entries().count() == 300
        groups = exact_dedup._groups(exact_dedup._digests(simhash.with_row_id(docs), "text", "doc_id"))
        assert again.unseen(groups).count() == 0
        got = rows_of(exact_dedup.decide(table(spark, [(500, "TEXT 7"), (501, "new")]), again))
        assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(500, 7, False), (501, 501, True)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, buckets=4)


def test_exact_dedup_in_batches_is_the_same(spark):
    rows = ROWS + [(200 + i, f"Twice {i % 7}") for i in range(40)]
    key = lambda r: (r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], bytes(r["digest"]))
    whole = rows_of(exact_dedup.decide(table(spark, rows)))
    for n in (2, 5):
        got = rows_of(exact_dedup.decide(table(spark, rows), batches=n))
        assert sorted(map(key, got)) == sorted(map(key, whole)) and sum(r["kept"] for r in got) == sum(r["kept"] for r in whole)
        assert {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in whole if r["kept"]}


def brute_simhash(text, width):
    w = lower(text).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("width", [3, 5])
def test_simhash_matches_brute_force(spark, width):
    rows = ROWS + [(100 + i, words(400, i // 6).replace(f"w{i % 6} ", "zz ", 1)) for i in range(60)]
    got = rows_of(simhash.near_duplicates(table(spark, rows), width=width))
    fps = {t: brute_simhash(t, width) for _, t, *_ in rows}
    want = brute_components([r[0] for r in rows], [fps[r[1]] for r in rows], 2)
    seen = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got)
    assert seen == Counter((r[0], fps[r[1]], c) for r, c in zip(rows, want))
    one = rows_of(simhash.one_of_each(table(spark, rows), width=width, distance=2, bits=64))
    assert sorted(r["doc_id"] or -1 for r in one) == sorted(c or -1 for c in set(want))
    assert rows_of(simhash.near_duplicates(table(spark, []))) == []


def shingles(text, width=5):
    w = lower(text).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_wide_simhash(spark):
    """All within 15 bits link, none beyond 38 but by others; copies with few edits are one component, others their own."""
    rng = random.Random(5)
    rows = list(ROWS)
    for g in range(12):
        base = words(500, 1000 + g, 3000).split()
        for k in range(6):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(500)] = f"edit{rng.random()}"
            rows.append((1000 + 10 * g + k, " ".join(copy)))
    rows += [(5000 + i, words(300, 7000 + i, 3000)) for i in range(40)]
    got = rows_of(simhash.near_duplicates(table(spark, rows), bits=256, distance=38))
    fps = [int.from_bytes(simhash.wide_simhash(lower(t), 5, 256), "big") for _, t, *_ in rows]
    floor, ceiling = ([(d, c) for (d, *_), c in zip(rows, brute_components([r[0] for r in rows], fps, n))] for n in (15, 38))
    mine = defaultdict(set)
    for r in got:
        mine[r["component_id"]].add(r["doc_id"])
    block = {d: c for c, ds in mine.items() for d in ds}
    for pairs, inside in ((floor, lambda a, b: block[a] == block[b]), ):
        for a, ca in pairs:
            for b, cb in pairs:
                assert ca != cb or inside(a, b)
    top = dict(ceiling)
    assert all(len({top[d] for d in ds}) == 1 for ds in mine.values())
    assert all(block[1000 + 10 * g + k] == 1000 + 10 * g for g in range(12) for k in range(6))
    assert all(block[5000 + i] == 5000 + i for i in range(40))
    one = rows_of(simhash.one_of_each(table(spark, rows)))
    assert sorted(r["doc_id"] or -1 for r in one) == sorted(c or -1 for c in mine)


def test_one_of_each_keeps_texts_that_share_a_repeated_line(spark):
    """A line that decides most bits of both texts, and pairs a little below the similarity, aren't near copies."""
    line = words(14, 1, 3000)
    texts = [words(64, 50 + i, 3000) + f" {line}" * 20 for i in range(2)]
    base = words(204, 77, 3000).split()
    texts += [" ".join(base), " ".join(base[:-25] + words(25, 78, 3000).split()), " ".join(base[:-15] + words(15, 79, 3000).split())]
    likeness = lambda i, j: len(shingles(texts[i]) & shingles(texts[j])) / len(shingles(texts[i]) | shingles(texts[j]))
    assert likeness(0, 1) < 0.25 and 0.7 < likeness(2, 3) < 0.8 < likeness(2, 4) and likeness(3, 4) < 0.8
    got = rows_of(simhash.one_of_each(table(spark, list(enumerate(texts)))))
    assert {0, 1, 2, 3} <= {r["doc_id"] for r in got}


def test_near_copies_are_found_down_to_the_similarity(spark):
    """Pairs of 0.8 to 0.86, against brute-force similarity: nearly all link; pairs of 0.74 to 0.8 don't."""
    rng, rows, near, far = random.Random(3), [], [], []
    for g in range(240):
        base = words(rng.randrange(60, 500), 20000 + g, 3000).split()
        k = round(len(base) * (0.08 + 0.06 * g / 240))
        pair = [" ".join(base), " ".join(base[:-k] + words(k, 30000 + g, 3000).split())]
        one, other = map(shingles, pair)
        (near if 5 * len(one & other) >= 4 * len(one | other) else far).append(g)
        rows += [(10 * g + i, t) for i, t in enumerate(pair)]
    kept = {r["doc_id"] for r in rows_of(simhash.one_of_each(table(spark, rows)))}
    found = sum(10 * g + 1 not in kept for g in near)
    print("found", found, "of", len(near))
    assert len(near) > 80 and len(far) > 60 and found >= 0.97 * len(near)
    assert all({10 * g, 10 * g + 1} <= kept for g in far)


def test_confirmed_links_are_exact(spark):
    texts = [words(40 + i // 10, i // 10, 3000).replace(" ", " x ", i % 10) for i in range(60)] + [None, "", "a b", "A  b"]
    docs = simhash.with_row_id(table(spark, list(enumerate(texts))))
    rows = simhash.wide_fingerprints(docs, 5, 256)
    nodes = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    nodes = materialize(nodes, "nodes")
    fp = {r["least"]["doc_id"]: bytes(r["fp"]) for r in nodes.collect()}
    pairs = [(i, j) for i in fp for j in fp if i < j]
    edges = spark.createDataFrame([(fp[i], fp[j]) for i, j in pairs], "a binary, b binary")
    got = {(bytes(r["a"]), bytes(r["b"])) for r in simhash.confirmed(edges, nodes, docs, 5, 0.8).collect()}
    sets = {i: shingles(texts[i]) for i in fp}
    assert got == {(fp[i], fp[j]) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} and got


def test_anchors_cover():
    rng = np.random.default_rng(0)
    words31 = rng.integers(0, 1 << 31, 200, dtype=np.uint64)
    other = words31 ^ (np.uint64(1) << rng.integers(0, 31, 200).astype(np.uint64))
    i, a = simhash.anchors(words31)
    j, b = simhash.anchors(other)
    near, far = defaultdict(set), defaultdict(set)
    for k, x in zip(i, a):
        near[k].add(int(x))
    for k, x in zip(j, b):
        far[k].add(int(x))
    assert all(near[k] & far[k] for k in range(200))
    assert max(map(len, near.values())) <= 16 and not simhash._syndromes(a).any()


@pytest.mark.parametrize("n", [40, 900])
def test_links_of_a_full_cell(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
    cell = np.unique(centre ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    a, b = simhash._links(cell, 2)
    got = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    near = np.bitwise_count(cell[:, None] ^ cell[None, :]) <= 2
    assert got == {(x, y) for x, y in zip(*np.nonzero(np.triu(near, 1)))}


def test_hot_components(spark):
    """A path and a star of many nodes."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    nodes = spark.range(1500).select(F.col("id").alias("node"))
    got = dict(simhash.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == (0 if i <= 300 else 1000 if 1000 <= i < 1400 else i) for i in range(1500))


@pytest.mark.parametrize("held", [16, 1 << 18])
def test_components_of_few_edges_take_no_shuffle_rounds(spark, monkeypatch, held):
    """Edges that a task can hold become stars there; with less room for them, the rounds find the same, binary nodes too."""
    made, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(simhash, "HELD", held, raising=False)
    rng = random.Random(4)
    path = rng.sample(range(1, 301), 300)
    edges = list(zip(path, path[1:])) + [(1000 + i, 1000) for i in range(1, 40)] + [(7, 7), (400, 401), (401, 400), (400, None)]
    rng.shuffle(edges)
    ids = list(range(450)) + list(range(1000, 1050))
    want = {i: 1 if 1 <= i <= 300 else 400 if i == 401 else 1000 if 1000 <= i < 1040 else i for i in ids}
    given = spark.createDataFrame(edges, "a long, b long").repartition(8)
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    assert dict(simhash.components(nodes, given).collect()) == want
    assert ("large-star" in made) == (held == 16)
    wide = lambda c: F.unhex(F.lpad(F.hex(c), 64, "0")).alias(c)
    got = simhash.components(nodes.select(wide("node")), given.select(wide("a"), wide("b"))).collect()
    assert {int.from_bytes(a, "big"): int.from_bytes(b, "big") for a, b in got} == want
    assert simhash.components(nodes, given.limit(0)).filter("node <> component").isEmpty()


def judge_brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.encode().lower().decode()
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/x?y#z", "http://example.com/en/1", "http://www.Example.com/en/1",
        "http://m.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://x.org/en/", "a://b://c.com/", "http://x.com?/en/", "http://ünet.net/es/\nq",
    ]
    df = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls + urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in rows_of(url_filter.judge(df, url_filter.UrlRules(spark, queries.URL_RULES), keep=("page_id",)))}
    assert len(got) == 2 * len(urls)
    for i, u in enumerate(urls + urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == judge_brute(u), u
    assert rows_of(url_filter.judge(df.limit(0), url_filter.UrlRules(spark, []))) == []


def test_url_filter_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://www.example.com/en/", "mine", 3, "x")], "page_id long, url string, host string, kept int, rule string")
    rules = url_filter.UrlRules(spark, spark.createDataFrame(queries.URL_RULES * 2, "host string, path string, verdict string"))
    got = url_filter.judge(df, rules, keep=("page_id", "host", "kept", "rule", "url"))
    assert got.columns == ["page_id", "kept", "url", "host", "path", "rule", "verdict"]
    assert got.first()[:] == (1, 3, df.first()["url"], "www.example.com", "/en/", "www.example.com/en/", "allow")


def test_url_rules_of_several_files(spark, monkeypatch):
    """Rules over many files, hosts and path lengths, and a long url, against a search of all rules."""
    monkeypatch.setattr(url_filter, "FILE_RULES", 50)
    rng = random.Random(2)
    rules = sorted({("K.com" if i % 9 == 0 else f"h{rng.randrange(40)}.com", "/" + "p" * rng.randrange(60)) for i in range(400)})
    rules = [(h, p, "block" if len(p) % 2 else "allow") for h, p in rules]
    urls = [f"http://{rng.choice(['', 'a.', 'b.c.'])}h{rng.randrange(45)}.com/{'p' * rng.randrange(70)}?q" for _ in range(300)] + ["http://k.com/" + "p" * 1_000_000, "http://\u212a.com/p"]
    found = url_filter.UrlRules(spark, rules)
    assert len(found.rules) > 3
    got = {r["url"]: (r["rule"], r["verdict"]) for r in rows_of(url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), found, keep=("url",)))}
    for u in urls:
        host, _, path = u.removeprefix("http://").partition("/")
        path = "/" + path.split("?")[0]
        fits = [(len(h + p), h.encode().lower().decode() + p, v) for h, p, v in rules if (host + "$").endswith(h.encode().lower().decode() + "$") and ("." + host).endswith("." + h.encode().lower().decode()) and path.startswith(p)]
        assert got[u] == (max(fits)[1:] if fits else (None, "allow")), u[:80]
    with pytest.raises(ValueError):
        url_filter.UrlRules(spark, [("a.com", "/", "allow"), ("A.com", "/", "block")])
    with pytest.raises(ValueError):
        url_filter.UrlRules(spark, [("a.com", "/", "maybe")])


def test_url_rules_confirm_collisions(spark, monkeypatch):
    rules = url_filter.UrlRules(spark, queries.URL_RULES)
    monkeypatch.setattr(url_filter, "_key", lambda text: 5)
    files = list(url_filter._lay_out(pa.RecordBatch.from_arrays([pa.array([h + p]), pa.array([int(v == "block")])], names=["text", "block"]) for h, p, v in queries.URL_RULES))
    data = np.frombuffer(files[0].column("data")[0].as_py(), np.uint8)
    n = int(data[:8].view(np.int64)[0])
    url_filter._mapped["same-keys"] = data[8 : 8 + 8 * n].view(np.uint64), data[8 + 8 * n : 8 + 16 * n].view(np.int64), data[8 + 16 * n : 8 + 17 * n], data[8 + 17 * n :]
    assert url_filter._find(["same-keys"], [b"net/es/", b"com/", b"org/es/"]).tolist() == [1, 0, -1]
    monkeypatch.undo()
    found, said = url_filter._probe((rules.rules, rules.hosts, rules.path_lengths), ["a.net", "a.org"], ["/es/1", "/es/1"])
    assert found == ["net/es/", None] and said == ["block", None]


def test_quality_learns_and_scores_all(spark):
    good = [(i, words(60, i)) for i in range(120)]
    bad = [(200 + i, words(60, i).upper() + " !! ##") for i in range(60)]
    docs = table(spark, good + bad + ROWS[:6])
    labels = spark.createDataFrame([(i, int(i < 200), "t") for i in [*range(0, 120, 2), *range(200, 260, 2)]] + [(1, None, "t"), (999, 1, "t")], "doc_id long, quality int, text string")
    model = quality.train(docs, labels)
    out = rows_of(docs.select("doc_id", quality.scorer(docs, model)(quality.body(docs)).alias("score")))
    assert len(out) == 186 and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert all(by_id[i] >= 0.5 for i in range(11, 120, 2)) and all(by_id[i] < 0.5 for i in range(201, 260, 2))
    ratio, weights, bias = quality.train(docs, labels.limit(0))
    assert not ratio.any() and not weights.any() and bias == 0


def test_quality_ratios_match_counts(spark):
    """Log-count ratios against counts of each row's n-grams, with repeated and unusable labels."""
    texts = {i: words(12, i, 30) + ("!" * (i % 4)) for i in range(40)}
    labels = [(i, i % 2, "t") for i in range(0, 30)] + [(3, 1, "t"), (None, 1, "t"), (31, None, "t"), (77, 0, "t")]
    docs = table(spark, [*texts.items(), (None, "no id")])
    ratio, _, _ = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"))
    rows, counts = [0, 0], np.zeros((2, 1 << quality.BITS))
    for i, c, _ in labels:
        if i in texts and c is not None:
            text = texts[i].encode()
            grams = {text[j : j + n] for n in range(1, 5) for j in range(len(text) - n + 1)}
            places = {(functools.reduce(lambda v, x: (v * 257 + x + 1) % 2**32, g, 0) * 2654435761 % 2**32) >> (32 - quality.BITS) for g in grams}
            counts[c, list(places)] += 1
            rows[c] += 1
    want = np.log((counts[1] + 1) / (rows[1] + 2)) - np.log((counts[0] + 1) / (rows[0] + 2))
    want[counts.sum(0) == 0] = 0
    assert np.allclose(ratio, want)


def test_hinge_fit_reaches_its_optimum():
    """The gap between the primal and the dual objective closes, so the fit is the optimum of the convex problem."""
    rng = np.random.default_rng(0)
    ratio = rng.normal(size=50)
    rows = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(80)]
    labels = np.array([int(ratio[r].sum() + rng.normal() > 0.5) for r in rows])
    w, bias = quality.hinge_fit(rows, labels, ratio, 1.0, 400)
    x = np.zeros((80, 51))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, 50] = 1
    y = np.where(labels == 1, 1.0, -1.0)
    upper = np.where(labels == 1, 0.5 / np.mean(labels == 1), 0.5 / np.mean(labels == 0))
    whole = np.r_[w, bias]
    primal = whole @ whole / 2 + upper @ np.maximum(0, 1 - y * (x @ whole))
    # the same problem's dual by projected gradient
    q, alpha = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(80)
    for _ in range(20000):
        alpha = np.clip(alpha - (q @ alpha - 1) / 80, 0, upper)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    assert abs(primal - dual) < 1e-3 * dual
    assert np.allclose(whole, (y * alpha) @ x, atol=0.02)


def test_quality_sample_and_joins(spark, monkeypatch):
    """The sort-merge join gives the model of the broadcast; an empty table has no scores; the sample keeps to its bound of features."""
    good, bad = [(i, words(40, i)) for i in range(60)], [(200 + i, words(40, i).upper()) for i in range(60)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in good + bad], "doc_id long, quality int")
    ratio, weights, bias = quality.train(docs, labels)
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    again = quality.train(docs, labels)
    assert np.array_equal(ratio, again[0]) and np.allclose(weights, again[1]) and abs(bias - again[2]) < 1e-9
    few = quality.train(docs, labels, max_features=4000)
    assert np.array_equal(ratio, few[0]) and (few[1] != 0).sum() < (weights != 0).sum()
    empty = quality.train(docs.limit(0), labels)
    assert not empty[0].any() and rows_of(docs.limit(0).select(quality.scorer(docs, empty)(quality.body(docs)).alias("score"))) == []


def test_quality_features_cover_whole_texts():
    seen = np.zeros(1 << quality.BITS, bool)
    text = b"ab" * quality.PIECE + b"\xffZZZ"
    found = set(quality.features(text, seen).tolist())
    assert set(quality.features(b"\xffZZZ", seen).tolist()) <= found and not seen.any() and len(quality.features(b"", seen)) == 0


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((scored.predicted == scored.quality).mean()) >= 0.93


@pytest.mark.parametrize("path,spaced,low", [(BYTE, True, False), (WORD, False, True)])
def test_encoder_is_exact(spark, path, spaced, low):
    texts = [r[1] or "" for r in ROWS] + [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a", "a  ", "\n x", "a \n b", "x.\u00a0y", "e\u0301 \u0301", "'s 'S it's  'll", "a\u2028 b", "日本 語。 ok", "٣ 4 ½ x²", "." * 300, "ab " * 40 + "\t \t"]
    texts += ["\u03a3\u0130?", "J\u030c j\u030c \u01f0!", "\u0130\u0130. I\u0307,", "\u039f\u0394\u039f\u03a3, \u03a3\u03a3 \u1e9e.", "E\u0301E\u0301! A\u030a", " ,lead", "tail, ", "x\x1cy \x1c z", "\ufb01 \u017f. \u2126?"]
    rng = random.Random(4)
    letters = ["a", "B", "\u03a3", "\u03c3", "\u0130", "I", "\u0307", "J", "\u030c", "\u00c9", "e", "\u0301", "?", ".", ",", "'", "s", " ", " ", "\n", "1", "\u65e5"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    coder, tight = Encoder(path, spaced, low), Encoder(path, spaced, low, memo_bytes=50)
    for coder in (coder, coder, tight, tight):
        got = as_bytes(*coder.encode(texts))
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    ended = as_bytes(*coder.encode(texts, 2))
    assert ended == [w + b"\2\0\0\0" for w in want]
    assert as_bytes(*coder.encode([])) == []


@pytest.mark.parametrize("path,spaced,low", [(BYTE, True, False), (WORD, False, True)])
def test_encoder_takes_long_texts_in_pieces(monkeypatch, path, spaced, low):
    monkeypatch.setattr("paperloom.llm.tokens.PIECE", 100)
    texts = [words(300, 3), "y" * 1000, "a  b " * 200 + "\n", "", "\u00c9t\u00e9 " * 300, words(10, 2)]
    plain = Tokenizer.from_file(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert as_bytes(*Encoder(path, spaced, low).encode(texts)) == want
    assert as_bytes(*Encoder(path, spaced, low, memo_bytes=500).encode(texts)) == want


def test_encoder_forgets_after_a_task():
    with encoder(BYTE, True) as coder:
        coder.encode(["some words to remember"])
        assert coder.held and coder.inner
    assert not coder.held and not coder.inner and coder.ids.count == 1


def ids_of(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def test_packing(spark):
    rows = [(r[0] if r[0] is not None else None, r[1]) for r in ROWS] + [(50 + i, words(900 + i, i)) for i in range(40)]
    got = rows_of(packing.pack(table(spark, rows), WORD, size=512, windows=4))
    by_doc = defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    want = defaultdict(list)
    for d, t in rows:
        ids = ids_of(WORD, t)
        want[d, len(ids)].append(ids)
    for key, copies in want.items():
        pieces = sorted(by_doc[key])
        if len(copies) == 1:
            assert [i for _, p in pieces for i in p] == copies[0]
            assert [s for s, _ in pieces] == [sum(len(p) for _, p in pieces[:k]) for k in range(len(pieces))]
        else:
            assert sum(len(p) for _, p in pieces) == sum(map(len, copies))
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        fills.append(at)
    assert max(fills) <= 512 and sum(f < 512 for f in fills) <= 1
    assert rows_of(packing.pack(table(spark, []), WORD)) == []


def test_token_store(spark):
    path = scratch_path(spark, "store")
    rows = ROWS + [(60 + i, words(50, i)) for i in range(30)]
    token_store.write_tokens(table(spark, rows), path, BYTE)
    got = rows_of(token_store.checksums(token_store.read_tokens(spark, path)).orderBy("start"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (d, t, *_) in zip(got, order, strict=True):
        ids = ids_of(BYTE, t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = rows_of(token_store.read_tokens(spark, path, [61, 9]))
    assert sorted(r["doc_id"] for r in some) == [9, 9, 61]
    plan = token_store.read_tokens(spark, path, [61])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [EqualTo(doc_id" in plan or "doc_id" in plan.split("PushedFilters")[1][:120]
    empty = scratch_path(spark, "store")
    token_store.write_tokens(table(spark, []), empty, BYTE)
    assert rows_of(token_store.checksums(token_store.read_tokens(spark, empty))) == []


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|x|> <|im_start|>assistant ok\n\n"), (1, 2, "assistant", "<"), (1, 3, "assistant", "|"),
        (2, 0, None, None), (2, 1, "assistant", None), (3, 5, "we\nird\\n <|", "a"), (3, 5, "we\nird\\n <|", "a"), (None, 1, "assistant", "z"), (4, None, "assistant", "é" * 5000), (4, 1, "system", ""),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, ids int")
    got = {r["conv_id"]: r for r in rows_of(chat.read_back(chat.format_turns(df, BYTE), BYTE))}
    groups = defaultdict(list)
    for t in turns:
        groups[t[0]].append(t[1:])
    assert set(got) == set(groups)
    for c, rows in groups.items():
        rows.sort(key=lambda r: [(x is not None, x or (0 if k == 0 else "")) for k, x in enumerate(r)])
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
        learnt = "".join(t or "" for _, r, t in rows if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest(), c
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(rows), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c]["formatted_chars"] >= len(said)
    for text in ("<|", "<\\|", "<\\\\|", "<<||", "a<|b<\\|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert rows_of(chat.read_back(chat.format_turns(df.limit(0), BYTE), BYTE)) == []


def test_fingerprints(spark):
    got = rows_of(fingerprints.edit_likeness(table(spark, ROWS), buckets=4))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    want = Counter((r[0], len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(order, texts, edited))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] and by_id[3]["near_next"] == 1
    assert by_id[7]["near_next"] > 0.9 and 0.2 < by_id[8]["near_edited"] < 0.8 and by_id[1]["near_next"] < 0.5
    assert len({r["fingerprint"] for r in got}) == len({t for t in texts})
    assert rows_of(fingerprints.edit_likeness(table(spark, []))) == []
    single = rows_of(fingerprints.edit_likeness(table(spark, [(5, "only one here")])))
    assert single[0]["edited_sha256"] == hashlib.sha256(b"only on" + b"only o").hexdigest()


def brute_fingerprint(text):
    """Exact and sketch lanes of a text, by the hashes' definition."""
    chain = lambda parts: functools.reduce(lambda seed, part: xxhash.xxh64_intdigest(part, seed), parts, 42)
    exact, sketch = [0] * fingerprints.EXACT, [0] * fingerprints.SKETCH
    for paragraph in text.split("\n"):
        for lane in range(fingerprints.EXACT):
            exact[lane] = (exact[lane] + (chain([lane.to_bytes(4, "little"), paragraph.encode()]) & (2**56 - 1))) % 2**56
        w = paragraph.split(" ")
        for gram in [w[i : i + 3] for i in range(len(w) - 2)] or [[" ".join(w)]]:
            h = chain([x.encode() for x in gram])
            sketch[h % fingerprints.SKETCH] += -1 if h & fingerprints.SKETCH else 1
    return exact, sketch


def test_fingerprints_match_brute_force(spark):
    got = rows_of(fingerprints.edit_likeness(table(spark, ROWS + [(40, "a b c d\na b c\n\nx")])))
    order = sorted(ROWS + [(40, "a b c d\na b c\n\nx")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    hexed = lambda f: "".join(f"{x:014x}" for x in f[0]) + "".join(f"{x % 2**32:08x}" for x in f[1])
    dot = lambda x, y: sum(a * b for a, b in zip(x[1], y[1]))
    alike = lambda x, y: max(0.0, min(1.0, 2 * dot(x, y) / (dot(x, x) + dot(y, y))))
    want = Counter()
    for r, t, n in zip(order, texts, texts[1:] + texts[:1]):
        own, edited, after = brute_fingerprint(t), brute_fingerprint(t[: len(t) - len(t) // 2] + n[: len(t) // 2]), brute_fingerprint(n)
        want[r[0], hexed(own), hexed(edited), round(alike(own, edited), 9), round(alike(own, after), 9)] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


def test_fingerprints_are_homomorphic(spark):
    parts = [words(20, i) for i in range(4)] + ["", "a b"]
    docs = table(spark, [(1, "\n".join(parts)), (2, "\n".join(parts[::-1])), (3, "\n".join(parts[:5])), (4, parts[5]), (5, None)])
    got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprint(docs))}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    wide = fingerprints.fingerprint(docs)
    a, b = (wide.filter(f"doc_id = {i}").select(F.col("exact").alias(f"x{i}"), F.col("sketch").alias(f"s{i}")) for i in (3, 4))
    both = a.join(b)
    exact, sketch = fingerprints.combine(F.col("x3"), F.col("s3"), F.col("x4"), F.col("s4"))
    added = both.select(exact.alias("x"), sketch.alias("s"), "x4", "s4", "x3", "s3")
    assert added.select(fingerprints.as_hex(F.col("x"), F.col("s"))).first()[0] == got[1]["fingerprint"]
    back = fingerprints.combine(F.col("x"), F.col("s"), F.col("x4"), F.col("s4"), -1)
    assert added.select(fingerprints.as_hex(*back)).first()[0] == got[3]["fingerprint"]


def test_mixing(spark):
    rows = [(i, words(30, i), "big") for i in range(600)] + [(1000 + i, words(30, i), "small") for i in range(60)] + [(None, None, None), (5, None, "empty")]
    docs = table(spark, rows)
    got = rows_of(mixing.mix(docs, weights={"big": 1.0, "small": 1.0}, by="docs", extras=True))
    per = Counter(r["doc"]["source"] for r in got)
    assert abs(per["big"] - 331) < 80 and abs(per["small"] - 331) < 80 and set(per) == {"big", "small"}
    assert len({(r["doc"]["doc_id"], r["copy"]) for r in got}) == len(got) and len({r["mix_key"] for r in got}) == len(got)
    assert sorted(r["mix_key"] for r in got) == sorted(r["mix_key"] for r in rows_of(mixing.mix(docs.repartition(7), weights={"big": 1.0, "small": 1.0}, by="docs", extras=True)))
    rate = {r["doc"]["source"]: r["rate"] for r in got}
    times = Counter(r["doc"]["doc_id"] for r in got)
    for d, _, s in rows:
        if s in rate:
            u = int(hashlib.md5(f"0|{d}".encode()).hexdigest()[:13], 16) / 2**52
            k, p, below = 0, math.exp(-rate[s]), math.exp(-rate[s])
            while below <= u:
                k += 1
                p *= rate[s] / k
                below += p
            assert times[d] == k
    plain = mixing.mix(docs)
    assert plain.columns == docs.columns
    assert rows_of(mixing.mix(table(spark, []))) == []


@pytest.mark.parametrize("rate", [1, 499, 700, 760, 5000, 100000])
def test_mixing_of_high_rates(spark, rate):
    """The quantile of each number at the rate, against sums of exact logarithms; counts have the rate's mean and variance."""
    us = [0.0, 1e-9, 0.5, 1 - 1e-9] + [(i + 0.5) / 300 for i in range(300)]
    df = spark.createDataFrame([(u, float(rate)) for u in us], "u double, rate double")
    df = df.withColumn("cdf", F.when(F.col("rate") <= mixing.CENTRED_RATE, mixing.poisson_cdf(F.col("rate"))))
    got = [r[0] for r in df.select(mixing.poisson_quantile(F.col("rate"), F.col("cdf"), F.col("u"))).collect()]
    last = math.ceil(rate + 12 * math.sqrt(rate) + 40)
    logs = np.array([k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(last + 1)])
    below = np.cumsum(np.exp(logs))
    for u, n in zip(us, got):
        if u:
            # the logarithms are good to some 1e-9 at 50,000
            assert np.searchsorted(below, u - 2e-9, "right") <= n <= np.searchsorted(below, u + 2e-9, "right"), u
    assert abs(np.mean(got[4:]) - rate) < 0.02 * rate ** 0.5 + 0.01 and abs(np.var(got[4:]) / rate - 1) < 0.05
    docs = table(spark, [(i, "x" * 100000, "big") for i in range(40)] + [(1000 + i, "ab", "small") for i in range(3)])
    many = mixing.mix(docs, weights={"big": 4000006 - 6 * rate, "small": 6 * rate}, extras=True)
    per = many.filter("doc.source = 'small'").groupBy("doc.doc_id").count().collect()
    assert all(abs(r["count"] - rate) < 6 * rate ** 0.5 + 1 for r in per) and (rate < 100 or len(per) == 3)


def planted(weight, symbols=200, k=12, seed=1):
    """Bigram counts of symbols with planted classes, and ``weight`` times the counts more of each with itself."""
    rng = np.random.default_rng(seed)
    true = np.r_[0, 1 + rng.integers(0, k - 1, symbols - 1)]
    chances = rng.dirichlet(np.full(k, 0.3), k)
    sizes = rng.zipf(1.5, symbols).clip(1, 300) * 3
    a = np.repeat(np.arange(symbols), sizes)
    share = np.array([np.where(true == c, sizes, 0) / max(1, sizes[true == c].sum()) for c in range(k)])
    b = np.array([rng.choice(symbols, p=share[rng.choice(k, p=chances[true[x]])]) for x in a])
    table = Counter(zip(a.tolist(), b.tolist()))
    for x in range(1, symbols):
        table[x, x] += int(weight * sizes[x])
    rows = np.array([(x, y, c) for (x, y), c in sorted(table.items()) if c])
    return rows[:, 0], rows[:, 1], rows[:, 2], true


def class_likelihood(classes, a, b, c, k):
    n = np.zeros((k, k))
    np.add.at(n, (classes[a], classes[b]), c)
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def exchange_by_recounting(classes, a, b, c, k):
    """Each symbol in turn to the class of the highest likelihood, recounted for every choice."""
    classes, before = classes.copy(), -np.inf
    counts = np.bincount(a, c, len(classes)) + np.bincount(b, c, len(classes))
    while class_likelihood(classes, a, b, c, k) > before + 1e-6:
        before = class_likelihood(classes, a, b, c, k)
        for s in np.argsort(-counts, kind="stable"):
            if s:
                options = []
                for new in range(1, k):
                    tried = classes.copy()
                    tried[s] = new
                    options.append(class_likelihood(tried, a, b, c, k))
                if max(options) > class_likelihood(classes, a, b, c, k) + 1e-9:
                    classes[s] = 1 + int(np.argmax(options))
    return classes


@pytest.mark.parametrize("weight", [0, 1, 5])
def test_exchange_reaches_that_of_brute_force(weight):
    k = 12
    a, b, c, true = planted(weight)
    start = np.r_[0, 1 + np.arange(199) % (k - 1)]
    got = brown_lm.exchange(start, a, b, c, k, passes=100)
    value = lambda x: class_likelihood(x, a, b, c, k)
    best = value(exchange_by_recounting(start, a, b, c, k))
    assert value(got) > value(start) and value(got) >= best - 0.01 * abs(best) and got[0] == 0 and (got[1:] > 0).all()

    def count(classes):
        right, left = np.zeros((200, k)), np.zeros((200, k))
        np.add.at(right, (a, classes[b]), c)
        np.add.at(left, (b, classes[a]), c)
        return right, left

    own = np.bincount(a[a == b], c[a == b], 200)
    to, gained = brown_lm.best_moves(start, np.arange(1, 200), *count(start), own, k)
    for s in range(0, 199, 10):  # gains are exact
        moved = start.copy()
        moved[s + 1] = to[s]
        assert abs(value(moved) - value(start) - gained[s]) < 1e-6 * abs(value(start))
    batched, right, history = brown_lm.exchange_batches(start, np.arange(1, 200), own, k, count, 200)
    assert all(x < y for x, y in zip(history, history[1:])) and abs(history[-1] - value(batched)) < 1e-6 * abs(best)
    assert np.array_equal(right, count(batched)[0]) and value(batched) > value(start)
    again, _, more = brown_lm.exchange_batches(got, np.arange(1, 200), own, k, count, 20)
    assert more[-1] >= value(got) - 1e-6


def test_brown_lm(spark):
    rows = [(i, " ".join(f"{'abc'[k % 3]}{(i * 7 + k * k) % 25}" for k in range(60)) + f" once{i} twice{i // 2}") for i in range(200)] + ROWS
    docs = table(spark, rows).withColumn("held_out", F.lit("clash"))
    learn = docs.filter(queries.fold("doc_id", 7) != 2)
    model = brown_lm.train(learn, classes=6, exchange_share=0.006, lookup_share=0.001, rounds=3)
    got = rows_of(brown_lm.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": queries.fold("doc_id", 7) == 2}))
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    counts = Counter()
    for d, t, *_ in rows:
        if fold(d) != 2:
            counts.update(lower(t).split() + [b"\n"])
    n, v = sum(counts.values()), len(counts)
    assert 1 < model.n_frequent < len(model.index) < v
    # every word of the training texts has a class of its own, and probabilities of a class add up to one
    cls = {bytes(r["word"]): (r["cls"], r["c"]) for r in model.rare.collect()}
    cls |= {w: (int(model.classes[i]), int(model.counts[i])) for w, i in model.index.items()}
    assert set(cls) == set(counts) and all(counts[w] == c for w, (_, c) in cls.items())
    assert [w for w, (k, _) in cls.items() if k == 0] == [b"\n"]
    unseen = 10 ** float(model.emission(np.array([model.unseen_class]), np.array([0]))[0])
    for k in {k for k, _ in cls.values()}:
        total = sum(10 ** float(model.emission(np.array([k]), np.array([c]))[0]) for j, c in cls.values() if j == k)
        assert abs(total + (unseen if k == model.unseen_class else 0) - 1) < 1e-9
    assert np.allclose(10.0**model.transition @ np.ones(6), 1)
    want = Counter()
    for d, t, *_ in rows:
        w = lower(t).split() + [b"\n"]
        of = [cls.get(x, (model.unseen_class, 0)) for x in w]
        score = sum(model.transition[p, k] + float(model.emission(np.array([k]), np.array([c]))[0]) for p, (k, c) in zip([0, *(k for k, _ in of)], of))
        want[d, fold(d) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6), round(score, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert len({model.classes[model.index[w]] for w in (b"a1", b"b1", b"c1") if w in model.index}) > 1
    none = brown_lm.train(docs.limit(0))
    assert len(rows_of(brown_lm.score(docs, none, {"doc_id": F.col("doc_id")}))) == len(rows)
    assert rows_of(brown_lm.score(docs.limit(0), model, {"doc_id": F.col("doc_id")})) == []


def test_very_long_texts_are_read_whole(spark):
    """A text of over a megabyte, and its copy that differs in the last word alone, through every operator on documents."""
    long = words(260_000, 5)
    rows = [(1, long), (2, long[:-1] + "zz"), (3, long.upper()), (4, "short one"), (5, None)]
    assert len(long) > 1_000_000
    docs = table(spark, rows)
    kept = {r["doc_id"]: r["keep_id"] for r in rows_of(exact_dedup.decide(docs))}
    assert kept == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    got = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(docs, width=3))}
    assert got[2]["fp"] & (2**64 - 1) == brute_simhash(rows[1][1], 3) and got[1]["component_id"] == got[3]["component_id"] == 1
    packed = defaultdict(list)
    for r in rows_of(packing.pack(docs, WORD)):
        packed[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for d, t in rows:
        assert b"".join(x for _, x in sorted(packed[d])) == np.array(ids_of(WORD, t), "<u4").tobytes()
    path = scratch_path(spark, "store")
    token_store.write_tokens(docs, path, BYTE)
    sums = {r["doc_id"]: r["ids_crc32"] for r in rows_of(token_store.checksums(token_store.read_tokens(spark, path)))}
    assert sums == {d: zlib.crc32(np.array(ids_of(BYTE, t), "<u4").tobytes()) for d, t in rows}
    model = brown_lm.train(docs, classes=4, exchange_share=0.02, lookup_share=0.004)
    scored = {r["doc_id"]: r for r in rows_of(brown_lm.score(docs, model, {"doc_id": F.col("doc_id")}))}
    assert scored[1]["n_tokens"] == 260_001 and scored[1]["score"] == scored[3]["score"] != scored[2]["score"] and math.isfinite(scored[2]["perplexity"])
    prints = {r["doc_id"]: r["fingerprint"] for r in rows_of(fingerprints.edit_likeness(docs))}
    assert len(set(prints.values())) == 5
    assert {len(r["text"] or "") for r in rows_of(mixing.mix(docs, alpha=1.0, budget=3.0))} <= {len(t or "") for _, t in rows}
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "<|im_end|>")], "conv_id long, turn long, role string, text string")
    back = rows_of(chat.read_back(chat.format_turns(turns, BYTE), BYTE))[0]
    assert back["loss_sha256"] == hashlib.sha256((long + "<|im_end|>").encode()).hexdigest()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, columns of names that the stages use, and an empty table."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, row string, label int, size long"
    good = [(i, words(60, i), "en", f"s{i % 2}", 5, "d", "f", "r", 1, 2) for i in range(40)]
    bad = [(100 + i, words(60, i).upper() + " !! ##", None, None, None, None, None, None, None, None) for i in range(40)]
    odd = [(None, None, None, None, None, None, None, None, None, None), (7, "", "", "", 0, "", "", "", 0, 0), (8, good[8][1], "en", "s0", 5, "d", "f", "r", 1, 2), (9, "x y z", None, "s1", None, "d", None, "r", 1, 2)]
    labels = [(r[0], 1, 0) for r in good[::2]] + [(r[0], 0, None) for r in bad[::2]] + [(None, 1, 0), (9999, None, None)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame(good + good[:3] + bad + odd + odd, schema).repartition(3)
    for rows in (docs, docs.limit(0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            before = kept.count()
            out = materialize(stage(spark, kept, sf), name)
            if name != "packing":
                assert out.columns == docs.columns, name
            if name == "quality" and before:
                assert not {r["doc_id"] for r in out.collect()} & {r[0] for r in bad} and {r[0] for r in good} <= {r["doc_id"] for r in out.collect()}
            if name == "exact_dedup" and before:
                found = [lower(r["text"]) for r in out.collect()]
                assert len(found) == len(set(found)) == len({lower(r["text"]) for r in kept.collect()})
            if name == "near_dedup" and before:
                assert out.count() == before  # none is near another
            kept = out
        assert (kept.count() > 0) == (rows is docs)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        path = scratch_path(spark, name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        assert name == "mixing" or 0 < kept.count() <= before
        if name == "exact_dedup":
            texts = [lower(r[0]) for r in kept.select("text").collect()]
            assert len(set(texts)) == len(texts)
        if name == "near_dedup":
            fps = [int.from_bytes(simhash.wide_simhash((r[0] or "").encode(), 5, 256), "big") for r in kept.select("text").collect()]
            assert all((a ^ b).bit_count() > 15 for i, a in enumerate(fps) for b in fps[:i])
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(ids_of(WORD, r[0])) for r in kept.select("text").collect())

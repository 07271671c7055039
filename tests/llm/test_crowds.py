"""Near copies among crowds of unlike texts, a batch that is retried, and keys that are null."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, fingerprints, simhash
from paperloom.llm.common import scratch_path


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def alike(a, b):
    return len(a & b) / len(a | b)


def template_pages(pairs, seed, size=240):
    """Pairs of pages with a similarity of about 0.82; any two pages share a template, by which they are 0.76 alike."""
    rng = random.Random(seed)
    words = lambda share: [f"u{rng.randrange(10**9)}" for _ in range(int(size * share))]
    template = [f"t{i}" for i in range(int(size * 0.865))]
    rows = []
    for k in range(pairs):
        both = words(0.04)
        rows += [(2 * k, " ".join(template + both + words(0.095))), (2 * k + 1, " ".join(template + both + words(0.095)))]
    return rows


def test_pairs_in_a_crowd_of_one_template(spark):
    rows = template_pages(120, 1)
    sets = [shingles(t) for _, t in rows]
    assert all(alike(sets[i], sets[i + 1]) >= 0.8 for i in range(0, len(rows), 2))
    assert max(alike(sets[i], sets[j]) for i in range(0, 40) for j in range(i + 1, 240) if j != i ^ 1) < 0.8
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bits=256, distance=72, sets=3, similarity=0.8)
    names = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert all(names[i] in (i, i ^ 1) for i in names)  # none is merged with another pair
    assert sum(names[i] == names[i + 1] for i in range(0, len(rows), 2)) >= 0.95 * len(rows) / 2


def test_crowd_links_are_all_links(spark):
    """Of groups of near copies and templates of several sizes: every pair of different components, by brute force."""
    rng = random.Random(9)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rng.randint(30, 150))]
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[f"e{rng.random()}"], [], [copy[i], f"e{rng.random()}"]])
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(texts))] + [(1000, "a b"), (1001, ""), (1002, None)]
    docs = simhash.with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))
    found = simhash.wide_fingerprints(docs, 5, 256)
    nodes = simhash.materialize(found.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("least")), "nodes")
    none = nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    links = simhash.crowd_links(nodes.select("fp"), nodes, docs, none, 5, 0.8)
    parts = simhash.components(nodes.select(F.col("fp").alias("node")), links)
    named = parts.join(nodes.select(F.col("fp").alias("node"), F.col("least.doc_id").alias("d")), "node").collect()
    label = {r["d"]: bytes(r["component"]) for r in named}
    sets = {d: shingles(t or "") for d, t in rows if d in label}
    ids, root = sorted(sets, key=str), {}
    root = {d: d for d in ids}

    def top(d):
        return d if root[d] == d else top(root[d])

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and alike(sets[a], sets[b]) >= 0.8:
                root[top(a)] = top(b)
    groups = lambda name: sorted(sorted(d for d in ids if name(d) == x) for x in {name(d) for d in ids})
    assert groups(label.get) == groups(top)
    assert 12 <= len(groups(top)) < len(ids)


@pytest.mark.parametrize("slice_size", [4096, 5])
def test_a_pair_that_a_cell_leaves_out_is_of_crowded_ones(slice_size, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", slice_size)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 4).astype(np.uint64)
    cell = np.unique(np.stack([base ^ (np.uint64(1) << rng.integers(0, 62, 4).astype(np.uint64)) for _ in range(40)] + [rng.integers(0, 1 << 62, 4).astype(np.uint64) for _ in range(20)]), axis=0)
    for label in (np.arange(len(cell)), np.minimum(np.arange(len(cell)), 12), np.arange(len(cell)) % 3):
        a, b, crowded = simhash._nearest(cell, label.astype(np.uint64), 20)
        made, left = set(zip(a.tolist(), b.tolist())), set(crowded.tolist())
        apart = np.bitwise_count(cell[:, None] ^ cell[None]).sum(-1)
        for i in range(len(cell)):
            for j in range(i + 1, len(cell)):
                if label[i] != label[j] and apart[i, j] <= 20:
                    assert (i, j) in made or {i, j} <= left


def test_a_batch_that_failed_can_run_again(spark):
    """It dies between the index and its own result; another batch of the same texts finds them known."""
    docs = spark.createDataFrame([(i, f"text {i % 15}") for i in range(20)], "doc_id long, text string")
    path = scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=3)
    first = sorted(r["doc_id"] for r in exact_dedup.survivors(docs, index, batch="monday").collect())
    index = exact_dedup.DigestIndex(spark, path)
    again = sorted(r["doc_id"] for r in exact_dedup.survivors(docs, index, batch="monday").collect())
    assert first == again and len(first) == 15
    assert index.entries().count() == 15
    # a try that got only some of its digests into the index
    part = scratch_path(spark, "index")
    half = exact_dedup.DigestIndex(spark, part, buckets=3)
    groups = exact_dedup._groups(exact_dedup._digests(exact_dedup.with_row_id(docs), "text", "doc_id"))
    half.append(groups.select("digest", F.col("best.doc_id").alias("keep_id"), "group_size").orderBy("keep_id").limit(6), "monday")
    assert sorted(r["doc_id"] for r in exact_dedup.survivors(docs, half, batch="monday").collect()) == first
    assert half.entries().count() == 15
    assert exact_dedup.survivors(docs, index, batch="tuesday").isEmpty() and exact_dedup.survivors(docs, index).isEmpty()
    decided = [exact_dedup.decide(docs, index, batches=2, batch="wednesday").filter("kept").count() for _ in range(2)]
    assert decided == [0, 0]


def test_fingerprints_of_null_keys(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (None, "e"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert set(got) == {None, 1, 2}
    joined = fingerprints.fingerprint(spark.createDataFrame([(7, "e"), (7, "a b c d")], "doc_id long, text string")).first()["fingerprint"]
    assert got[None] == joined
    assert fingerprints.fingerprint(docs, keys=()).count() == 1
    few = fingerprints.edit_likeness(docs).collect()
    many = fingerprints.edit_likeness(docs, buckets=50).collect()
    assert sorted(map(str, few)) == sorted(map(str, many))

"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (line) hashes to a wide vector: ``EXACT`` lanes of whole-paragraph
hashes modulo 2**56 and ``SKETCH`` lanes modulo 2**32, in which each three-word
shingle of the paragraph adds +1 or -1 to the lane its hash picks (a shorter
paragraph is one shingle). A document's vector is the sum of its paragraphs',
so the order of paragraphs doesn't matter, and inserting or deleting one adds or
subtracts its vector. Equal multisets of paragraphs have equal vectors; the exact
lanes tell different ones apart; the sketch lanes estimate how much two share:
``2 x.y / (x.x + y.y)``, between 0 and 1.

Native expressions only. Rows meet their successors by one exchange on ranges of
ids; long texts are exploded and summed inside their partition.

Defined results: null text counts as empty, and the empty text has one empty
paragraph; null ids sort first; repeated ids sort by text; an empty table gives
an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import shuffle_partitions

EXACT, SKETCH = 4, 64
#: Text of a range of ids, about: what one task sorts.
RANGE_BYTES = 4 << 30
_LOW56, _TWO32 = (1 << 56) - 1, 1 << 32


def exact_lanes(body: str) -> Column:
    """Sums modulo 2**56 of the hashes of the paragraphs of column ``body``."""
    one = "aggregate(split({0}, '\\n'), 0L, (a, p) -> (a + (xxhash64({1}, p) & {2}L)) & {2}L)"
    return F.array(*[F.expr(one.format(body, lane, _LOW56)) for lane in range(EXACT)])


def shingle_hashes(body: str) -> Column:
    """Hashes of the three-word shingles of each paragraph, repeats included."""
    return F.expr(
        f"flatten(transform(transform(split({body}, '\\n'), p -> split(p, ' ')), "
        "w -> if(size(w) < 3, array(xxhash64(array_join(w, ' '))), "
        "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))))"
    )


def _sketch_sums() -> list[Column]:
    sign = F.expr(f"if(h & {SKETCH} = 0, 1, -1)")
    lane = F.expr(f"cast(h & {SKETCH - 1} as int)")
    return [F.sum(F.when(lane == j, sign).otherwise(0)).alias(f"s{j}") for j in range(SKETCH)]


def likeness(a: Column, b: Column) -> Column:
    """How much two sketches share, 0 to 1; two without shingles are alike."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = dot(a, a) + dot(b, b)
    return F.when(norm == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / norm)))


def as_hex(exact: Column, sketch: Column) -> Column:
    wide = F.transform(exact, lambda x: F.lpad(F.hex(x), 14, "0"))
    small = F.transform(sketch, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(_TWO32))), 8, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(small, "")))


def fingerprint(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, exact, sketch, fingerprint`` for each distinct key; rows of one key are added up as one multiset."""
    rows = df.select(*[df[k] for k in keys], F.coalesce(df[text].cast("string"), F.lit("")).alias("fp_body"))
    wide = rows.select(*keys, shingle_hashes("fp_body").alias("hashes")).select(*keys, F.explode("hashes").alias("h"))
    sketch = wide.groupBy(*keys).agg(*_sketch_sums())
    lanes = rows.select(*keys, exact_lanes("fp_body").alias("lanes"))
    exact = lanes.groupBy(*keys).agg(*[F.pmod(F.sum(F.col("lanes")[i].cast("decimal(38,0)")), F.lit(1 << 56)).cast("long").alias(f"e{i}") for i in range(EXACT)])
    # the parts of one key are put together by one more sum of two rows, so that null keys meet too
    names = [f"s{j}" for j in range(SKETCH)] + [f"e{i}" for i in range(EXACT)]
    both = sketch.unionByName(exact, allowMissingColumns=True).groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])
    out = both.select(*keys, F.array(*[f"e{i}" for i in range(EXACT)]).alias("exact"), F.array(*[f"s{j}" for j in range(SKETCH)]).alias("sketch"))
    return out.withColumn("fingerprint", as_hex(F.col("exact"), F.col("sketch")))


def combine(exact: Column, sketch: Column, more_exact: Column, more_sketch: Column, sign: int = 1) -> tuple[Column, Column]:
    """Insert (``sign`` 1) or delete (-1) paragraphs whose lanes are given."""
    return (
        F.zip_with(exact, more_exact, lambda a, b: F.pmod(a + sign * b, F.lit(1 << 56))),
        F.zip_with(sketch, more_sketch, lambda a, b: a + sign * b),
    )


def _ranges_of(rows: DataFrame) -> int:
    """How many ranges hold ``RANGE_BYTES`` of ``text`` each."""
    return -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)


def _ranges(docs: DataFrame, buckets: int) -> tuple[list, object, bool]:
    """Ids that start a bucket, the smallest id, whether any id is null."""
    shares = ", ".join(str((i + 1) / buckets) for i in range(buckets - 1)) or "0.5"
    got = docs.agg(
        F.expr(f"percentile_approx(doc_id, array({shares}), {max(20_000, 4 * buckets)})").alias("cuts"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False)).alias("nulls"),
    ).first()
    cuts = sorted({c for c in got["cuts"] or [] if c != got["least"] or got["nulls"]}) if buckets > 1 else []
    return cuts, got["least"], got["nulls"]


def edit_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose second half is the next document's start.

    ``buckets`` ranges of ids, of about ``RANGE_BYTES`` of text each unless told, are dealt out by one exchange; the
    first document of a range is also sent to the range before, and the first of
    all to the last, so every row finds its successor in its own partition.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    buckets = buckets or max(8 * shuffle_partitions(docs.sparkSession), _ranges_of(rows))
    cuts, least, nulls = _ranges(rows, buckets)
    starts = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    own = F.size(F.filter(starts, lambda c: F.coalesce(c <= F.col("doc_id"), F.lit(False)))) if cuts else F.lit(0)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    places = F.array(
        F.struct(F.col("own").alias("part"), F.lit(0).alias("ghost")),
        F.when(F.col("own") > 0, F.when(F.element_at(starts, F.greatest(F.col("own"), F.lit(1))) == F.col("doc_id"), F.struct((F.col("own") - 1).alias("part"), F.lit(1).alias("ghost")))) if cuts else F.lit(None),
        F.when(first, F.struct(F.lit(len(cuts)).alias("part"), F.lit(2).alias("ghost"))),
    )
    dealt = rows.withColumn("own", own).select("doc_id", "text", F.explode(F.array_compact(places)).alias("place")).select("doc_id", "text", "place.part", "place.ghost")
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    paired = (
        dealt.withColumn("seq", F.row_number().over(order))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("n_chars", n.cast("long"))
        .withColumn("half", F.floor(n / 2).cast("int"))
    )
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - half)"), F.expr("substring(next_text, 1, half)"))
    bodies = paired.select(
        "part", "seq", "ghost", "doc_id", "n_chars",
        F.explode(F.when(F.col("ghost") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), edited.alias("body"))))
                  .otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"))))).alias("v"),
    ).select("part", "seq", "ghost", "doc_id", "n_chars", "v.kind", "v.body")
    hashed = bodies.select(
        "part", "seq", "kind", "ghost", "doc_id", "n_chars",
        F.when(F.col("kind") == 1, F.sha2("body", 256)).alias("sha"),
        exact_lanes("body").alias("exact"),
        shingle_hashes("body").alias("hashes"),  # before the explode, so that it is computed once a row
    ).select("part", "seq", "kind", "ghost", "doc_id", "n_chars", "sha", "exact", F.explode("hashes").alias("h"))
    # all that a row carries is a grouping key: a hash aggregate holds no strings in its sums
    summed = hashed.groupBy("part", "seq", "kind", "ghost", "doc_id", "n_chars", "sha", "exact").agg(*_sketch_sums())
    vectors = summed.select("part", "seq", "kind", "ghost", "doc_id", "n_chars", "sha", "exact", F.array(*[f"s{j}" for j in range(SKETCH)]).alias("sketch"))
    walk = Window.partitionBy("part").orderBy("seq", "kind")
    met = vectors.select(
        "*",
        F.lead(F.struct("sha", "exact", "sketch")).over(walk).alias("edit"),
        F.lead("sketch", 2).over(walk).alias("next_sketch"),
    ).filter("kind = 0 and ghost = 0")
    return met.select(
        "doc_id",
        "n_chars",
        F.col("edit.sha").alias("edited_sha256"),
        as_hex(F.col("exact"), F.col("sketch")).alias("fingerprint"),
        as_hex(F.col("edit.exact"), F.col("edit.sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edit.sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

"""Mixing sources to target weights by Poisson replication.

Each source gets a rate: the mean number of times one of its documents shall
occur, so that the source's characters make up its share of the mix. A
document's uniform number is a hash of seed and id; its count is the
Poisson quantile of that number at the source's rate. Documents are exploded by
count and dealt out by a hash of seed, id and copy number, which also orders
every partition: a global shuffle in one exchange.

Only per-source totals (summed map-side) meet in one place. Rates are joined by
broadcast while at most ``MAX_BROADCAST_SOURCES`` sources exist, else by a
sort-merge join that Spark splits where one source is hot. Native expressions
throughout.

Defined results: null text counts as empty, null source is a source of its own,
null ids hash as the empty string; repeated rows, and rows of one id, have one
count; a number on a step of the distribution gets the higher count; long texts
count with all their characters; sources without characters have rate 0 unless
weights are by document; an empty table gives an empty result; other columns are
kept as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, shuffle_partitions

MAX_BROADCAST_SOURCES = 10_000
#: Above this rate exp(-rate) comes near the least double; counts are found in a range around the mean.
CENTRED_RATE = 500.0


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5, as a number in [0, 1)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... up to where a double can't tell it from one."""
    steps = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"),
        ),
    )
    return terms["cdf"]


def centred_quantile(rate: Column, u: Column) -> Column:
    """The least count whose P(at most that count) is over ``u``, for rates above ``CENTRED_RATE``.

    P(count = k) starts from its logarithm 12 standard deviations under the mean (with Stirling's series, the large terms
    cancelled), below which no double tells the sum from zero, and goes on by its recurrence as far above.
    """
    first = F.floor(rate - 12 * F.sqrt(rate)).cast("long")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("long")
    k = first.cast("double")
    log_p = (k - rate) - k * F.log1p((k - rate) / rate) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    p = F.exp(log_p)
    found = F.aggregate(
        F.sequence(first + 1, last),
        F.struct(p.alias("p"), p.alias("below"), F.when(p <= u, first + 1).otherwise(first).alias("count")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            (acc["below"] + acc["p"] * rate / k).alias("below"),
            F.when(acc["below"] + acc["p"] * rate / k <= u, k + 1).otherwise(acc["count"]).alias("count"),
        ),
    )
    return found["count"].cast("int")


def poisson_quantile(rate: Column, cdf: Column, u: Column) -> Column:
    """Count at the uniform number ``u``; ``cdf`` is that of :func:`source_rates`."""
    return F.when(rate > CENTRED_RATE, centred_quantile(rate, u)).otherwise(F.size(F.filter(cdf, lambda c: c <= u)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0, by: str = "chars", source: str = "source", text: str = "text") -> DataFrame:
    """``src, rate, cdf``: the mean repetitions of a document of each source; cdf is null above ``CENTRED_RATE``.

    ``weights`` gives target shares (sources not named get none); without it, a
    source's share is its size to the power ``alpha``. ``budget`` is the size of the
    mix in units of the input's. ``by``: sizes in ``chars`` or ``docs``.
    """
    measure = F.length(F.coalesce(docs[text].cast("string"), F.lit(""))) if by == "chars" else F.lit(1)
    sizes = docs.select(docs[source].cast("string").alias("src"), measure.cast("long").alias("n")).groupBy("src").agg(F.sum("n").alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("src") == name, float(weight)).otherwise(share)
    sizes = materialize(sizes.withColumn("share", share), "source-sizes")
    totals = sizes.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("share"))).alias("share")).first()
    if not totals["share"]:
        rate = F.lit(0.0)
    else:
        rate = F.when(F.col("size") > 0, F.col("share") / totals["share"] * budget * totals["size"] / F.col("size")).otherwise(0.0)
    rates = sizes.select("src", rate.alias("rate"))
    return materialize(rates.withColumn("cdf", F.when(F.col("rate") <= CENTRED_RATE, poisson_cdf(F.col("rate")))), "source-rates")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0, by: str = "chars", seed: int = 0, source: str = "source", text: str = "text", doc_id: str = "doc_id", extras: bool = False) -> DataFrame:
    """``docs`` replicated and shuffled; with ``extras`` also ``doc, copy, rate, mix_key`` (doc: a struct)."""
    rates = source_rates(docs, weights, alpha, budget, by, source, text)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        docs[source].cast("string").alias("doc_src"),
        docs[doc_id].cast("string").alias("key"),
    )
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    found = rows.join(rates, F.col("doc_src").eqNullSafe(F.col("src")))
    u = _uniform(F.lit(seed), F.col("key"))
    counted = found.withColumn("u", u).withColumn("times", poisson_quantile(F.col("rate"), F.col("cdf"), F.col("u")))
    copies = counted.filter("times > 0").select("doc", "key", "rate", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    mix_key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("key", F.lit("")), F.col("copy")))
    mixed = copies.withColumn("mix_key", mix_key).repartition(shuffle_partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")
    if extras:
        return mixed.select("doc", "copy", "rate", "mix_key")
    return mixed.select("doc.*")

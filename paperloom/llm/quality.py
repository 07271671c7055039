"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams (1 to 4) of the whole text, hashed to
``2**BITS`` places. Each is scaled by its class log-count ratio, counted over all
labelled rows, and a linear hinge-loss model is fitted to the scaled, normalised
indicators by dual coordinate descent, on at most ``max_rows`` labelled rows with
``max_features`` features in all (the smallest hashes of their ids, half of either
class where there are enough). Texts become features in the tasks that read them;
only those of the sample are brought together, and only the weights are broadcast,
``2**BITS`` numbers.

Defined results: null text counts as empty and gets the score of no features; long
texts are read whole, in pieces; a null label, or one without a document, is not
learnt from; repeated labels count each time; without labels of both classes every
score is 0.5; a score of 0.5 counts as good; repeated rows get one row each; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize

BITS = 18
#: Labels are broadcast while they take at most so many bytes; more are joined by sort-merge.
BROADCAST_BYTES = 32 << 20
#: Of a label in a broadcast table.
LABEL_BYTES = 48
#: Long texts are read in pieces of this many bytes.
PIECE = 1 << 18


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Places of the n-grams of a text, once each. ``seen``: scratch of ``2**BITS`` False values, left as it was."""
    for at in range(0, len(text), PIECE):
        b = np.frombuffer(text, np.uint8, min(PIECE + 3, len(text) - at), at).astype(np.uint32) + np.uint32(1)
        gram = np.zeros(len(b), np.uint32)
        for n in range(min(4, len(b))):
            gram = gram[: len(b) - n] * np.uint32(257) + b[n:]
            seen[(gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class and rows that have each feature, for this partition; place -1 counts rows."""
    seen, counts, rows = np.zeros(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        for text, label in zip(batch.column("body").to_pylist(), batch.column("label").to_pylist()):
            counts[label, features(text, seen)] += 1
            rows[label] += 1
    place = np.flatnonzero(counts.any(0))
    table = [np.r_[-1, place], np.r_[rows[0], counts[0, place]], np.r_[rows[1], counts[1, place]]]
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in table], names=["place", "n0", "n1"])


def hinge_fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss by dual coordinate descent; classes weigh alike."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(len(ratio)), 0.0
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    upper = cost * 0.5 / share[labels]
    norms = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    small = marks.count() * LABEL_BYTES <= BROADCAST_BYTES
    return rows.join(F.broadcast(marks) if small else marks, F.col("id") == F.col("mark_id")).select("id", "label", "body")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BITS, bool)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            found = [features(t, seen).astype(np.int32) for t in some.column("body").to_pylist()]
            sizes = [len(f) for f in found]
            places = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([some.column("o"), some.column("label"), places, pa.array(sizes, pa.int64())], names=["o", "label", "places", "n"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_features: int = 32_000_000, cost: float = 1.0, epochs: int = 8, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> tuple[np.ndarray, np.ndarray, float]:
    """``ratio, weights, bias`` from the documents that ``labels`` marks 0 or 1."""
    draw = F.pmod(F.xxhash64(F.lit("sample"), "mark_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    marks = labels.select(labels[doc_id].alias("mark_id"), labels[label].cast("int").alias("label")).filter("label IN (0, 1) AND mark_id IS NOT NULL")
    rows = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("body"))
    counted = _marked(rows, marks).select("body", "label").mapInArrow(_count, "place bigint, n0 bigint, n1 bigint")
    counts = counted.groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # 2**BITS rows at most
    ratio, totals = np.zeros(1 << BITS), np.zeros(2)
    if len(counts):
        totals = counts.loc[counts.place == -1, ["n0", "n1"]].to_numpy(float).sum(0)
        counts = counts[counts.place >= 0]
    if totals.min() == 0:
        return ratio, ratio, 0.0
    p, q = counts.n1.to_numpy() + 1.0, counts.n0.to_numpy() + 1.0
    ratio[counts.place.to_numpy()] = np.log(p / (totals[1] + 2)) - np.log(q / (totals[0] + 2))
    few = int(min(totals.min(), max_rows // 2))
    want = {int(np.argmin(totals)): few, int(np.argmax(totals)): max_rows - few} if totals[0] != totals[1] else {0: few, 1: few}
    # a little more than the rows wanted by a hash of their ids, whatever the number of labels, then exactly those
    chance = F.when(F.col("label") == 1, (1.1 * want[1] + 20) / totals[1]).otherwise((1.1 * want[0] + 20) / totals[0])
    some = rows.join(F.broadcast(marks.filter(draw <= chance)), F.col("id") == F.col("mark_id"))
    sample = materialize(some.select(F.xxhash64("id").alias("o"), "label", "body").mapInArrow(_featured, "o bigint, label int, places array<int>, n bigint"), "sample")
    order = Window.partitionBy("label").orderBy("o", "places")
    sample = sample.withColumn("r", F.row_number().over(order)).withColumn("held", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.when(F.col("label") == 1, want[1]).otherwise(want[0])
    picked = sample.filter((F.col("r") <= limit) & ((F.col("held") <= max_features // 2) | (F.col("r") == 1)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, marks = [], []
        for batch in batches:
            lists = batch.column("places")
            found += np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
            marks += batch.column("label").to_pylist()
        if found:
            w, bias = hinge_fit(found, np.array(marks), ratio, cost, epochs)
            place = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, place].astype(np.int64)), pa.array(np.r_[bias, w[place]])], names=["place", "weight"])

    one = picked.orderBy("label", "r").select("label", "places").coalesce(1)  # max_rows rows and max_features features at most
    fitted = one.mapInArrow(fit, "place bigint, weight double").toPandas()
    weights = np.zeros(1 << BITS)
    inner = fitted[fitted.place >= 0]
    weights[inner.place.to_numpy()] = inner.weight.to_numpy()
    return ratio, weights, float(fitted.weight[fitted.place == -1].iloc[0])


def scorer(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], slope: float = 4.0):
    """A function from a text column (binary) to its score, a logistic of the margin."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) if isinstance(x, np.ndarray) else x for x in model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio, weights, bias = shared.value
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                f = features(text, seen)
                r = ratio[f].astype(np.float64)
                out[i] = weights[f].astype(np.float64) @ r / max(np.sqrt(r @ r), 1e-9) + bias
            yield pd.Series(1 / (1 + np.exp(-slope * out)))

    return score


def body(docs: DataFrame, text: str = "text") -> Column:
    """A text column as the bytes that :func:`scorer` reads."""
    return F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")

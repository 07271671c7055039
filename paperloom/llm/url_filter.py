"""URL rules by a sorted digest array.

Rules are ``host + path-prefix -> allow | block``. Spark deals them out by hash and
lays each part out as one file: sorted 64-bit xxhash keys, rule strings, verdicts.
The files go to each executor, where tasks memory-map them. The distinct hosts of rules lie beside them in the same way. A url's host and
its parents are probed first; those that have rules yield one candidate key per
rule-path length, all candidates of a batch are probed by one vectorised binary
search per file, and each hit is confirmed against the stored string, so two keys
with one hash never mix.

Any number of rules may be given: no task or driver holds more than one file of
about ``FILE_RULES`` of them.

Defined results: a null url or one without ``://`` has empty host and path and
gets the default verdict; hosts, of urls and rules, are lower-cased in A-Z only;
urls are read whole, however long; repeated rows get one row each, repeated rules
count once; an empty table gives an empty result, no rules the default verdict; of
the rules that fit, the one with the longest ``host + path`` wins, then the longer
host; a column to keep that has a result's name is left out in its favour.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, materialize

#: Rules in a file, about.
FILE_RULES = 2_000_000
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_mapped: dict[str, tuple] = {}


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's distinct ``text, block`` as the bytes of its file."""
    rows: dict[bytes, int] = {}
    for batch in batches:
        rows.update(zip((t.encode() for t in batch.column("text").to_pylist()), batch.column("block").to_pylist()))
    if rows:
        keys = np.fromiter(map(_key, rows), np.uint64, len(rows))
        order = np.argsort(keys, kind="stable")
        texts, blocks = list(rows), np.fromiter(rows.values(), np.uint8, len(rows))
        raw = [texts[i] for i in order.tolist()]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data = np.array([len(raw)], np.int64).tobytes() + keys[order].tobytes() + ends.tobytes() + blocks[order].tobytes() + b"".join(raw)
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.large_binary()).cast(pa.binary())], names=["data"])


class UrlRules:
    """Rules ``host, path, verdict``, a DataFrame or tuples, as files of sorted keys that each executor gets."""

    def __init__(self, spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str, str]], default: str = "allow"):
        if not isinstance(rules, DataFrame):
            rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
        given = rules.select(ascii_lower(rules["host"]).alias("host"), F.coalesce(rules["path"].cast("string"), F.lit("")).alias("path"), rules["verdict"].alias("verdict"))
        given = materialize(given.withColumn("text", F.concat("host", "path")), "url-rules")
        wrong = given.filter(~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))).select("verdict").first()
        if wrong:
            raise ValueError(f"verdict must be allow or block: {wrong[0]}")
        twice = given.groupBy("text").agg(F.count_distinct("verdict").alias("n")).filter("n > 1").first()
        if twice:
            raise ValueError(f"a rule has both verdicts: {twice[0]}")
        self.default = default
        self.path_lengths = sorted(r[0] for r in given.select(F.length("path")).distinct().collect())
        self.rules = self._ship(spark, given.select("text", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("block")))
        self.hosts = self._ship(spark, given.select(F.col("host").alias("text"), F.lit(0).alias("block")).distinct())

    @staticmethod
    def _ship(spark: SparkSession, rows: DataFrame) -> list[str]:
        """A file for each part of the rows; they pass through the driver one at a time."""
        n = rows.count() // FILE_RULES + 1
        names, folder = [], tempfile.mkdtemp(prefix="spark-")
        for row in rows.repartition(n, F.xxhash64("text")).mapInArrow(_lay_out, "data binary").toLocalIterator():
            names.append(f"urlrules-{uuid.uuid4().hex}.bin")
            with open(os.path.join(folder, names[-1]), "wb") as f:
                f.write(row[0])
            spark.sparkContext.addFile(os.path.join(folder, names[-1]))
        return names


def _open(name: str) -> tuple:
    if name not in _mapped:
        data = np.memmap(SparkFiles.get(name), np.uint8, "r")
        n = int(data[:8].view(np.int64)[0])
        keys, ends = data[8 : 8 + 8 * n].view(np.uint64), data[8 + 8 * n : 8 + 16 * n].view(np.int64)
        _mapped[name] = keys, ends, data[8 + 16 * n : 8 + 17 * n], data[8 + 17 * n :]
    return _mapped[name]


def _find(names: list[str], texts: list[bytes]) -> np.ndarray:
    """1 for each of the texts that is stored and marked as blocking, 0 for one stored otherwise, -1 for one that isn't."""
    out = np.full(len(texts), -1, np.int8)
    probes = np.fromiter(map(_key, texts), np.uint64, len(texts))
    for name in names:
        keys, ends, blocks, raw = _open(name)
        first, last = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
        for j in np.flatnonzero(last > first).tolist():
            for k in range(first[j], last[j]):  # keys that share a hash
                if raw[ends[k - 1] if k else 0 : ends[k]].tobytes() == texts[j]:
                    out[j] = blocks[k]
    return out


def _probe(rules: tuple[list[str], list[str], list[int]], hosts: list[str], paths: list[str]) -> tuple[list, list]:
    """Rule and verdict (None where none fits) for each host and path."""
    rule_files, host_files, lengths = rules
    known: dict[str, bool] = {}
    cut = [[host[k:] for k in [0, *(k + 1 for k, ch in enumerate(host) if ch == ".")]] if host else [] for host in hosts]
    parents = sorted({s for own in cut for s in own})
    known = dict(zip(parents, (_find(host_files, [s.encode() for s in parents]) >= 0).tolist()))
    owner, cand, rank = [], [], []
    for i, (own, path) in enumerate(zip(cut, paths)):
        own = [s for s in own if known[s]]
        prefixes = [path[:n] for n in lengths if n <= len(path)] if own else []
        for s in own:
            for prefix in prefixes:
                owner.append(i)
                cand.append(s + prefix)
                rank.append((len(s) + len(prefix), len(s)))
    said, verdicts = [None] * len(hosts), [None] * len(hosts)
    best: dict[int, tuple] = {}
    blocks = _find(rule_files, [c.encode() for c in cand])
    for j in np.flatnonzero(blocks >= 0).tolist():
        i = owner[j]
        if i not in best or rank[j] > best[i][0]:
            best[i] = rank[j], cand[j], "block" if blocks[j] else "allow"
    for i, (_, rule, verdict) in best.items():
        said[i], verdicts[i] = rule, verdict
    return said, verdicts


def judge(df: DataFrame, rules: UrlRules, url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, then host, path, rule (null if none fits) and verdict of each row's url."""
    text = df[url].cast("string")
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(
        F.struct(F.lit(0).alias("_"), *[df[c] for c in keep]).alias("kept"),
        ascii_lower(F.regexp_extract(text, _HOST, 1)).alias("host"),
        F.coalesce(F.regexp_extract(text, _PATH, 1), F.lit("")).alias("path"),
    )
    shipped, default = (rules.rules, rules.hosts, rules.path_lengths), rules.default

    @F.pandas_udf("rule string, verdict string")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found, said = _probe(shipped, hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": found, "verdict": [v or default for v in said]}, dtype="object")

    judged = parts.withColumn("judged", probe("host", "path"))
    return judged.select(*[F.col("kept")[c].alias(c) for c in keep], "host", "path", "judged.rule", "judged.verdict")

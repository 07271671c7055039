"""A corpus of four tables (manifest, pages, chunks, stories) whose sources are replaced together.

Rows lie in folders by the hash of their source. A commit writes the folders that it changes anew, for all four tables,
beside the old ones, and last of all one small file that says which folders are current. Readers take the newest such file,
so during a commit, and after one that died, they see all four tables as they were before it or as they are after it.
Two commits that start from one state can't both be written: the second fails and may be tried again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.operators.retrieval import small
from paperloom.session import kept

TABLES = ("manifest", "pages", "chunks", "stories")


class ConflictError(ValueError):
    """Replacements that can't be taken in, or a commit that another one has overtaken."""


class VersionedCorpus:
    """The corpus at ``path``; ``buckets`` counts its folders per table and is fixed by its first commit.

    Every table has a column ``source``; the manifest has one row per source, and its ``owner``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, tables: tuple[str, ...] = TABLES):
        self.spark, self.path, self.buckets, self.tables = spark, path.rstrip("/"), buckets, tables

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def state(self) -> dict:
        """The newest whole commit: its number, the folder of each bucket and table, schemas, and the last batch of each stream."""
        for name in reversed(self._names(f"{self.path}/commits")):
            found = self.spark.read.text(f"{self.path}/commits/{name}", wholetext=True).first()
            try:
                return json.loads(found[0] if found else "")
            except ValueError:
                continue  # its writer died
        return {"commit": 0, "buckets": self.buckets, "folders": {t: {} for t in self.tables}, "schemas": {}, "streams": {}}

    def read(self, table: str, state: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table as of a ``state`` (the newest), or its buckets ``only``; None before the first commit."""
        state = state or self.state()
        if table not in state["schemas"]:
            return None
        schema = StructType.fromJson(state["schemas"][table])
        paths = [p for b, p in state["folders"][table].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(F.col("source").cast("string")), F.lit(state["buckets"])).cast("int")

    def _check(self, incoming: dict[str, DataFrame], state: dict) -> None:
        new = incoming["manifest"].select("source", "owner")
        twice = new.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR source IS NULL").select("source", F.lit("more than one row").alias("why"))
        faults = [twice]
        for t in self.tables[1:]:
            faults.append(incoming[t].select("source").join(new, "source", "left_anti").distinct().select("source", F.lit(f"{t} without a manifest row").alias("why")))
        old = self.read("manifest", state)
        if old is not None:
            met = old.select("source", F.col("owner").alias("held")).join(new, "source").filter(~F.col("held").eqNullSafe(F.col("owner")))
            faults.append(met.select("source", F.lit("another owner").alias("why")))
        found = faults[0]
        for f in faults[1:]:
            found = found.unionByName(f)
        some = found.limit(20).collect()
        if some:
            raise ConflictError("; ".join(f"{r['source']}: {r['why']}" for r in some))

    def replace(self, incoming: dict[str, DataFrame], stream: str | None = None, batch: int = 0) -> int:
        """Replace all rows of the sources in ``incoming["manifest"]`` by those of ``incoming``; returns the commit's number.

        Each row is written once, by the task that has it, and is not shuffled; what is refused is written too, and deleted. A ``batch`` of a ``stream`` that is in already, or one before it, changes nothing. Sources listed twice, of another owner than before, or
        with rows but without a manifest row are refused.
        """
        state = self.state()
        if stream is not None and batch <= state["streams"].get(stream, -1):
            return state["commit"]
        bucket, folder = self._bucket(state), f"data/{uuid.uuid4().hex}"
        write = lambda t, rows: rows.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{folder}/{t}")
        none = lambda schema: self.spark.createDataFrame([], schema)
        incoming = incoming | {"manifest": kept(incoming["manifest"], "incoming-manifest")}
        kinds = {t: StructType.fromJson(state["schemas"][t]) if t in state["schemas"] else None for t in self.tables}
        told = {"manifest": incoming["manifest"]}
        for t in self.tables:
            new = incoming[t] if kinds[t] is None else none(kinds[t]).unionByName(incoming[t], allowMissingColumns=True)
            write(t, new)
            if t != "manifest":
                told[t] = self.spark.read.schema(new.select("source").schema).parquet(f"{self.path}/{folder}/{t}") if self._names(f"{self.path}/{folder}/{t}") else none(new.select("source").schema)
        try:
            self._check(told, state)
        except ConflictError:
            fs, place = self._fs(f"{self.path}/{folder}")
            fs.delete(place, True)
            raise
        sources = small(kept(incoming["manifest"].select("source"), "incoming-sources"))
        changed = sorted(r["b"] for r in sources.select(bucket.alias("b")).distinct().collect())  # buckets at most
        folders = {t: dict(state["folders"].get(t, {})) for t in self.tables}
        schemas = dict(state["schemas"])
        for t in self.tables:
            old, new = self.read(t, state, changed), none(incoming[t].schema)
            rows = new if old is None else old.join(sources, "source", "left_anti").unionByName(new, allowMissingColumns=True)
            schemas[t] = json.loads(rows.schema.json())
            if old is not None:
                write(t, rows)
            written = {int(n.partition("=")[2]): f"{folder}/{t}/{n}" for n in self._names(f"{self.path}/{folder}/{t}") if n.startswith("bucket=")}
            for b in changed:
                folders[t].pop(str(b), None)
                if b in written:
                    folders[t][str(b)] = written[b]
        streams = state["streams"] | ({stream: batch} if stream is not None else {})
        return self._commit({"commit": 0, "buckets": state["buckets"], "folders": folders, "schemas": schemas, "streams": streams}, state)

    def _commit(self, made: dict, before: dict) -> int:
        """Write the pointer, which must not be there yet; a torn one of a dead writer is passed over."""
        taken = [int(n.partition(".")[0]) for n in self._names(f"{self.path}/commits")]
        if self.state()["commit"] != before["commit"]:
            raise ConflictError("another commit came first")
        made["commit"] = max([before["commit"], *taken]) + 1
        fs, place = self._fs(f"{self.path}/commits/{made['commit']:012d}.json")
        try:
            out = fs.create(place, False)
        except Py4JJavaError as e:
            raise ConflictError("another commit came first") from e
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        return made["commit"]

    def clean(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` commits names; readers of older states lose them."""
        names = [n for n in self._names(f"{self.path}/commits")][-keep:]
        rows = [self.spark.read.text(f"{self.path}/commits/{n}", wholetext=True).first() for n in names]
        used = {p.split("/")[1] for r in rows if r for t in json.loads(r[0])["folders"].values() for p in t.values()}
        dropped = [n for n in self._names(f"{self.path}/data") if n not in used]
        for n in dropped:
            fs, place = self._fs(f"{self.path}/data/{n}")
            fs.delete(place, True)
        return len(dropped)

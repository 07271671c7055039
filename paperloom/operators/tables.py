"""Keeping the tables of a workspace: inventory, policies, replacement, reconciliation, drift.

Each operation takes the old table and returns the new one; :func:`overwrite` writes it beside
the old data and swaps. Joins are equi joins on the workspace's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import records as R


def latest(df: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """The newest row of each key. One struct per key is kept map-side, so a hot key doesn't gather."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(order, *ties, F.struct(*rest).alias("row"))).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.row.{c}").alias(c) for c in rest]).select(df.columns)


def with_policies(inventory: DataFrame, policies: DataFrame, key: str = "name") -> DataFrame:
    """Inventory with each item's policy; without one the tag is unknown and access undecided."""
    joined = inventory.join(policies, key, "left")
    return joined.withColumn("unresolved", F.col("tag").isNull()).withColumn("tag", F.coalesce("tag", F.lit("unknown")))


def pending(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """``source, revision, needs``: whether each listed source has to be indexed."""
    have = manifest.select("source", "status", F.col("revision").alias("have"), "embedding_status", "provider", F.lit(True).alias("exists"))
    joined = inventory.join(have, "source", "left")
    return R.with_needs_index(joined).select("source", "revision", "needs")


def removed(tables_sources: DataFrame, inventory: DataFrame) -> DataFrame:
    """Sources that aren't listed, or are listed as neither eligible nor unresolved."""
    alive = inventory.filter("eligible OR unresolved").select("source")
    return tables_sources.select("source").distinct().join(alive, "source", "left_anti")


def searchable(manifest: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """Indexed documents whose source is eligible; without an inventory, all indexed ones."""
    indexed = manifest.filter("status = 'indexed'")
    if inventory is None:
        return indexed
    return indexed.join(inventory.filter("eligible").select("source"), "source", "left_semi")


def replace_documents(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """Rows of the sources in ``new`` are replaced as a whole; the rest stays."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new)


def record_attempts(manifest: DataFrame, attempts: DataFrame) -> DataFrame:
    """Failed or skipped attempts (``source, outcome, revision, error``) against the manifest.

    An indexed source whose content is the same keeps its row and gets only ``last_error``; any other takes the outcome.
    """
    tried = attempts.select("source", F.col("outcome"), F.col("revision").alias("tried"), "error")
    joined = manifest.join(tried, "source", "full_outer")
    keeps = (F.col("status") == "indexed") & (R.content_identity(F.col("revision")) == R.content_identity(F.col("tried")))
    none = F.col("outcome").isNull()
    keep = F.coalesce(none | keeps, F.lit(False))
    return joined.select(
        "source",
        F.when(keep, F.col("status")).otherwise(F.col("outcome")).alias("status"),
        F.when(keep, F.col("revision")).otherwise(F.col("tried")).alias("revision"),
        F.col("error").alias("last_error"),
    )


def override_metadata(manifest: DataFrame, overrides: DataFrame) -> DataFrame:
    """User titles (``source, title, aliases``) win, locked and certain; aliases are trimmed and distinct."""
    told = overrides.select("source", F.col("title").alias("user_title"), F.array_distinct(F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: a != "")).alias("user_aliases"))
    joined = manifest.join(told, "source", "left")
    has = F.col("user_title").isNotNull()
    return joined.select(
        *[c for c in manifest.columns if c not in ("title", "aliases", "confidence", "provenance")],
        F.coalesce("user_title", "title").alias("title"),
        F.coalesce("user_aliases", "aliases").alias("aliases"),
        F.when(has, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(has, "user").otherwise(F.col("provenance")).alias("provenance"),
    )


def drift(current: DataFrame, remote: DataFrame) -> DataFrame:
    """``name, state`` (missing, extra, stale) between the current inventory and a snapshot's, both ``name, identity``."""
    joined = current.select("name", F.col("identity").alias("here"), F.lit(1).alias("c")).join(remote.select("name", F.col("identity").alias("there"), F.lit(1).alias("r")), "name", "full_outer")
    state = F.when(F.col("r").isNull(), "missing").when(F.col("c").isNull(), "extra").when(~F.col("here").eqNullSafe(F.col("there")), "stale")
    return joined.select("name", state.alias("state")).filter("state IS NOT NULL")


def reconcile_selection(previous: DataFrame, known: DataFrame, eligible: DataFrame) -> DataFrame:
    """``name``: the previous choice as far as eligible, plus eligible names that weren't known before."""
    fresh = eligible.select("name").join(known.select("name"), "name", "left_anti")
    return previous.select("name").intersect(eligible.select("name")).union(fresh).distinct()


def journal_matches(journal: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads that can go on where the newest journal row of the name has the same size and root."""
    newest = latest(journal, ["network", "owner", "name"], "updated_at")
    found = uploads.join(newest.select("network", "owner", "name", F.col("size").alias("j_size"), F.col("root").alias("j_root"), "stage"), ["network", "owner", "name"])
    return found.filter((F.col("size") == F.col("j_size")) & (F.col("root") == F.col("j_root"))).drop("j_size", "j_root")


def corpus_metrics(manifest: DataFrame) -> DataFrame:
    """One row: indexed documents, their pages and chunks, vectors ready, page-weighted text coverage (null without weight)."""
    weight = F.when((F.col("type") == "text") & F.col("text_coverage").isNotNull(), F.col("page_count"))
    pages = F.when(F.col("type") == "text", F.col("page_count"))
    return manifest.filter("status = 'indexed'").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(pages), F.lit(0)).alias("pages"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
        F.count_if(F.col("embedding_status") == "ready").alias("semantic_ready"),
        F.when(F.sum(weight) > 0, F.sum(F.col("text_coverage") * weight) / F.sum(weight)).alias("text_coverage"),
    )


def quality_warnings(manifest: DataFrame) -> DataFrame:
    """``source, warning`` rows by the rules for failed, outdated, empty, thin and vectorless sources."""
    text = F.col("type") == "text"
    empty = text & ((F.coalesce("page_count", F.lit(0)) == 0) | (F.coalesce("chunk_count", F.lit(0)) == 0))
    indexed = F.col("status") == "indexed"
    full = indexed & text & ~empty
    rules = [
        (F.col("status") == "failed", "failed"),
        (F.col("status") == "upgrade_required", "upgrade_required"),
        (indexed & empty, "no_evidence"),
        (full & (F.col("text_coverage") < 0.75), "low_coverage"),
        (full & (F.col("page_count") > 2) & (F.col("chunk_count") == 1), "one_chunk"),
        (full & (F.col("embedding_status") == "failed"), "no_vectors"),
    ]
    return manifest.select("source", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("warning"))


def rate_decisions(events: DataFrame, limit: int = 30, seconds: int = 60, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """``event, key, allowed``: a key's window opens at its first event, lasts so many seconds and opens again at the next.

    Events stream through in order of key and time with one window's state, however many a key has.
    """
    import pandas as pd

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(event).alias("event"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def decide(batches):
        held, ends, count = object(), 0, 0
        for b in batches:
            out = []
            for k, at in zip(b.key, b["at"]):
                if k != held or at >= ends:
                    held, ends, count = k, at + seconds * 1_000_000, 0
                count += 1
                out.append(count <= limit)
            yield pd.DataFrame({"event": b.event, "key": b.key, "allowed": out})

    kinds = dict(rows.dtypes)
    ordered = rows.repartition(n, "key").sortWithinPartitions("key", "at", "event")
    return ordered.mapInPandas(decide, f"event {kinds['event']}, key {kinds['key']}, allowed boolean")


def call_audit(calls: DataFrame, run: str, signature: list[str], order: list[str], limit: int) -> DataFrame:
    """``calls`` (with ``known``: the tool exists) with ``status`` in call order: unknown, duplicate of a signature of the same run, over the run's limit, executed."""
    copy = F.row_number().over(Window.partitionBy(run, *signature).orderBy(*order))
    nth = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    counted = calls.withColumn("copy", copy).withColumn("nth", nth)
    status = F.when(~F.col("known"), "unknown").when(F.col("copy") > 1, "duplicate").when(F.col("nth") > limit, "limit").otherwise("executed")
    return counted.withColumn("status", status).drop("copy", "nth")


def work_queue(items: DataFrame, tie: str = "source") -> DataFrame:
    """Rows ``is_new, pending, indexed, eligible`` in the order in which they are worked on."""
    place = (
        F.when(F.col("pending") & F.col("is_new"), 0).when(F.col("pending"), 1).when(F.col("indexed"), 2).when(F.col("eligible"), 3).otherwise(4)
    )
    return items.withColumn("priority", place).orderBy("priority", tie)


def last_messages(messages: DataFrame, n: int = 20) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)


def turn_pairs(messages: DataFrame, pairs: int = 5, user_chars: int = 2000, answer_chars: int = 4000) -> DataFrame:
    """The last user turns that an assistant turn directly follows, with the start of both texts."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    paired = after.filter("role = 'user' AND next_role = 'assistant'")
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = paired.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= pairs)
    return kept.select("conv_id", "turn", F.substring("text", 1, user_chars).alias("question"), F.substring("answer", 1, answer_chars).alias("answer"))


def eligible_column(decision: Column, tag: Column, written: Column, deleted: Column, expires_micros: Column, now_micros: Column) -> Column:
    """Written, not deleted, not expired, access granted, and public or time-locked."""
    alive = F.coalesce(written, F.lit(True)) & ~F.coalesce(deleted, F.lit(False)) & ~F.coalesce(expires_micros <= now_micros, F.lit(False))
    return alive & decision["eligible"] & tag.isin("public", "time_lock")

"""Reading loosely shaped JSON records: access information, conversation routes, scopes that a question names. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import records as R

# Fixed values.
UNLOCK_FIELDS = ["unlockAtMicros", "unlockAt", "unlockTime"]
SCOPES = ["general", "document", "image", "tool"]
IMAGE_ACTIONS = ["show", "describe"]
# End of fixed values.


def _get(record: Column, path: str) -> Column:
    return F.get_json_object(record, f"$.{path}")


def _list(value: Column) -> Column:
    """Addresses of a JSON array or of a comma-separated string: trimmed, lower-cased, without empty ones."""
    items = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.split(value, ","))
    plain = F.transform(items, lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.filter(plain, lambda x: x != ""), F.array().cast("array<string>"))


def with_access_info(df: DataFrame, record: str) -> DataFrame:
    """``df`` with ``access_info`` of its JSON column ``record``: tag, unlock_at_micros, allowlist, purchasers, can_access, requires_decryption, on_chain, unresolved.

    A policy in ``accessPolicy`` decides alone; one of an unknown or custom type leaves the access unresolved. Else the first
    of several places that holds a value counts: the record, its ``metadata``, its ``access`` (or ``accessControl``) object.
    The record is parsed once, step by step.
    """
    fields = ["accessPolicy", "metadata", "access", "accessControl", "tags", "accessTag", "tag", "timeLock", "allowlist", "purchasers", *UNLOCK_FIELDS]
    inner = ["access", "accessControl", "tags", "accessTag", "tag", "timeLock", "allowlist", "purchasers", *UNLOCK_FIELDS]
    taken = ["tag", "timeLock", "allowlist", "addresses", "purchasers", "purchasedBy", *UNLOCK_FIELDS]
    parse = lambda column, names: F.from_json(column, ", ".join(f"{n} string" for n in names))
    c = F.col
    unlock = lambda at: [c(f"{at}.{f}") for f in UNLOCK_FIELDS]
    none = F.array().cast("array<string>")
    lists = lambda *parts: F.when(c("a_kind") != "", none).otherwise(F.array_distinct(F.concat(*[_list(c(p)) for p in parts])))
    steps = {
        "a_r": parse(c(record), fields),
        "a_m": parse(c("a_r.metadata"), inner),
        "a_a": parse(F.coalesce("a_r.access", "a_m.access", "a_r.accessControl", "a_m.accessControl"), taken),
        "a_t": parse(F.coalesce("a_r.timeLock", "a_m.timeLock", "a_a.timeLock"), UNLOCK_FIELDS),
        "a_p": parse(c("a_r.accessPolicy"), ["type", "lockedUntilMicros", "canAccess", "greenBoxByteLength"]),
        "a_kind": F.coalesce("a_p.type", F.lit("")),
        "a_open": c("a_kind").isin("unknown", "custom"),
        "a_decided": (c("a_kind") != "") & ~c("a_open"),
        "a_tag": F.coalesce("a_r.accessTag", "a_r.tag", "a_m.accessTag", "a_m.tag", "a_a.tag", F.get(F.from_json(F.coalesce("a_r.tags", "a_m.tags"), "array<string>"), F.lit(0))),
        "a_stamp": F.when(c("a_decided"), c("a_p.lockedUntilMicros")).when(~c("a_open"), F.coalesce(*unlock("a_r"), *unlock("a_m"), *unlock("a_a"), *unlock("a_t"))),
        "a_allow": lists("a_r.allowlist", "a_m.allowlist", "a_a.allowlist", "a_a.addresses"),
        "a_buyers": lists("a_r.purchasers", "a_m.purchasers", "a_a.purchasers", "a_a.purchasedBy"),
    }
    out = df
    for name, value in steps.items():
        out = out.withColumn(name, value)
    kind = c("a_kind")
    policy = F.when(kind == "none", "public").when(kind == "timelock", "time_lock").when(kind == "purchasable", "purchasable").otherwise("allowlist")
    info = F.struct(
        F.when(c("a_decided"), policy).when(c("a_open"), "public").otherwise(R.normalize_access_tag(c("a_tag"))).alias("tag"),
        R.parse_timestamp_micros(c("a_stamp")).alias("unlock_at_micros"),
        c("a_allow").alias("allowlist"),
        c("a_buyers").alias("purchasers"),
        F.when(c("a_decided"), c("a_p.canAccess").cast("boolean")).alias("can_access"),
        F.coalesce(c("a_decided") & (c("a_p.greenBoxByteLength").cast("bigint") > 0), F.lit(False)).alias("requires_decryption"),
        (kind != "").alias("on_chain"),
        c("a_open").alias("unresolved"),
    )
    return out.withColumn("access_info", info).drop(*steps)


def normalize_route(value: Column, available: Column) -> Column:
    """``scope, referenced_sources, image_action, confidence`` of a JSON route: known scopes, offered sources, actions for images alone, 0 to 1."""
    scope = _get(value, "scope")
    known = F.coalesce(scope.isin(SCOPES), F.lit(False))
    sources = F.array_distinct(F.array_intersect(F.from_json(_get(value, "referencedSources"), "array<string>"), available))
    action = _get(value, "imageAction")
    return F.struct(
        F.when(known, scope).otherwise("general").alias("scope"),
        F.coalesce(F.when(scope.isin("document", "image"), sources), F.array().cast("array<string>")).alias("referenced_sources"),
        F.when((scope == "image") & action.isin(IMAGE_ACTIONS), action).alias("image_action"),
        F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get(value, "confidence").try_cast("double"), F.lit(0.0))))).otherwise(0.0).alias("confidence"),
    )


def mentioned_scopes(question: Column, scopes: dict[str, str]) -> Column:
    """The names, in their order, whose pattern occurs in the lower-cased question as words."""
    low = F.lower(question)
    found = [F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"), F.lit(name)) for name, pattern in scopes.items()]
    return F.array_compact(F.array(*found))


def scope_mismatch(mentioned: Column, active: Column) -> Column:
    """Whether a question names scopes, but not the active one."""
    return F.coalesce((F.size(mentioned) > 0) & ~F.array_contains(mentioned, active), F.lit(False))


def holds_any(answer: Column, marks: list[str]) -> Column:
    """Whether an answer holds one of the marks, in whatever case: texts that must not leave the system."""
    low = F.lower(answer)
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(low, F.lit(mark.lower()))
    return found


def highlight(text: Column, excerpt: Column) -> Column:
    """``before, match, after``: where the trimmed excerpt first stands in the text; null where it doesn't."""
    needle = F.trim(excerpt)
    at = F.instr(text, needle)
    parts = F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), needle.alias("match"), F.substring(text, at + F.length(needle), F.length(text)).alias("after"))
    return F.when((needle != "") & (at > 0), parts)

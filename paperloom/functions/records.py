"""Keys, revisions, access rules, citations and other small record functions. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NETWORKS = ["mainnet", "testnet", "devnet", "local"]
DEFAULT_NETWORK = "testnet"
RETRYABLE = r"(?i)\.(pdf|png|jpe?g|gif|webp|mp4|txt|md|markdown|json|jsonl|map|html?|xml|csv|tsv|ya?ml|toml|tsx?|jsx?|css|scss|move)$"
V10, V11 = "v10:quota-controls:", "v11:content-sniffer-v2:quota-controls:"
V9 = "v9:mp4-hot-rag:"
PACKAGE_NAMES = r"(?i)\.(kb\.json|kb-snapshot\.json|kb-snapshot\.pack)$"
GUIDE_NAMES = r"(?i)(^|/)(agents?|skills?)\.md$"
IMAGE_NAMES = r"(?i)\.(jpg|jpeg|png|gif|webp)$"
VIDEO_NAMES = r"(?i)\.(mp4|m4v|mov)$"
DOCUMENT_NAMES = r"(?i)\.(pdf|txt|md|markdown|csv|tsv|json|jsonl|html?|xml|ya?ml)$"
VIDEO_BRANDS = r"^(isom|iso[2-9]|mp4[12]|avc1|dash|M4V )$"
STILL_BRANDS = r"^(avif|avis|heic|heix|hevc|hevx|mif1|msf1)$"
PACKAGE_FORMATS = ["kb-package", "kb-snapshot"]
# End of fixed values.


def workspace_key(network: Column, owner: Column) -> Column:
    return F.concat_ws(":", F.lower(network), F.lower(owner))


def parse_workspace_key(key: Column) -> Column:
    """``network, owner``; a key without a known prefix belongs to the default network."""
    head = F.substring_index(key, ":", 1)
    known = head.isin(NETWORKS) & F.contains(key, F.lit(":"))
    rest = F.when(known, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key)
    return F.struct(F.when(known, head).otherwise(DEFAULT_NETWORK).alias("network"), F.lower(rest).alias("owner"))


def content_identity(revision: Column) -> Column:
    """The first three parts of a revision, empty if it has fewer."""
    parts = F.split(F.coalesce(revision, F.lit("")), ":", -1)
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), ":")).otherwise("")


def revision_pipeline(revision: Column) -> Column:
    parts = F.split(F.coalesce(revision, F.lit("")), ":", -1)
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), ":")).otherwise("")


def build_revision(size: Column, created: Column, tag: Column, pipeline: Column) -> Column:
    stamp = F.coalesce(created.cast("string"), F.lit("unknown"))
    return F.concat_ws(":", F.coalesce(size, F.lit(0)).cast("string"), stamp, tag, pipeline)


def with_needs_index(df: DataFrame, expected: str = "revision", have: str = "have") -> DataFrame:
    """``df`` (source, status, embedding_status, provider, exists, and the two revisions) with ``needs``.

    Whether a source has to be indexed (again): rewrites of old pipeline names are compatible, and so are
    permissions that were turned off. Step by step, so that each rewrite is computed once.
    """
    starts = lambda c, p: F.startswith(c, F.lit(p))
    as_v11 = lambda c: F.when(starts(c, V10), F.concat(F.lit(V11), F.substring(c, F.lit(len(V10) + 1), F.length(c)))).otherwise(c)
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b) if isinstance(b, str) else b)
    c = F.col
    steps = {
        "n_same": content_identity(c(have)) == content_identity(c(expected)),
        "n_have": revision_pipeline(c(have)),
        "n_want": revision_pipeline(c(expected)),
        "n_v10": F.when(starts(c("n_have"), V9), F.regexp_replace(F.concat(F.lit(V10), F.substring(c("n_have"), F.lit(len(V9) + 1), F.length("n_have"))), "^(.*?):embedding-", "$1:cloud-read-off:embedding-")).otherwise(c("n_have")),
        "n_asked": F.regexp_extract("n_want", ":embedding-(gemini|gateway):", 1),
        "n_auto": F.when((c("embedding_status") == "ready") & (c("provider") == c("n_asked")) & (c("n_asked") != ""), c("n_asked")).otherwise("auto"),
        "n_v11": swap(as_v11(c("n_v10")), ":embedding-auto:", F.concat(F.lit(":embedding-"), c("n_auto"), F.lit(":"))),
        "n_read": F.when(F.contains("n_want", F.lit(":cloud-read-off:")), swap(c("n_v11"), ":cloud-read-on:", ":cloud-read-off:")).otherwise(c("n_v11")),
        "n_final": F.when(F.contains("n_want", F.lit(":embedding-off:")), F.regexp_replace("n_read", ":embedding-(auto|gemini|gateway):", ":embedding-off:")).otherwise(c("n_read")),
        "n_skip": (c(have) == c(expected)) | (c("n_same") & (as_v11(c("n_have")) == c("n_want")) & ~c("source").rlike(RETRYABLE)),
    }
    out = df
    for name, value in steps.items():
        out = out.withColumn(name, value)
    indexed = F.when(c(have) == c(expected), False).when(~c("n_same"), True).otherwise(c("n_final") != c("n_want"))
    needs = (
        F.when(~F.coalesce("exists", F.lit(False)), True)
        .when(c("status") == "skipped", ~F.coalesce("n_skip", F.lit(False)))
        .when(F.coalesce("status", F.lit("")) != "indexed", True)
        .otherwise(F.coalesce(indexed, F.lit(True)))
    )
    return out.withColumn("needs", needs).drop(*steps)


def citation_ids(answer: Column) -> Column:
    """Distinct ``S<n>`` inside square brackets, leading zeros dropped, in order."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(?<![A-Za-z0-9_])[Ss](\d+)(?![A-Za-z0-9_])"), F.lit(1))))
    plain = F.transform(numbers, lambda n: F.regexp_replace(n, "^0+(?=.)", ""))
    return F.array_distinct(F.transform(plain, lambda n: F.concat(F.lit("S"), n)))


def normalize_access_tag(value: Column) -> Column:
    """allowlist, purchasable, time_lock, or public for anything else."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("public")))), "[\\s-]+", "_")
    return (
        F.when(key.isin("allowlist", "allow_list", "whitelist"), "allowlist")
        .when(key.isin("purchasable", "purchase", "paid"), "purchasable")
        .when(key.isin("time_lock", "timelock", "time_locked", "scheduled"), "time_lock")
        .otherwise("public")
    )


def parse_timestamp_micros(value: Column) -> Column:
    """Numbers below 1e11 are seconds, below 1e14 milliseconds, else microseconds; other text is a date; null unless positive."""
    number = F.when(F.trim(value).rlike(r"^\d+(\.\d+)?$"), F.trim(value).try_cast("double"))
    scaled = F.when(number < 1e11, number * 1e6).when(number < 1e14, number * 1e3).otherwise(number)
    date = F.unix_micros(value.try_cast("timestamp"))
    return F.when(number > 0, F.floor(scaled)).when(number.isNull(), date).cast("long")


def input_kind(name: Column) -> Column:
    return (
        F.when(name.rlike(PACKAGE_NAMES), "package")
        .when(name.rlike(IMAGE_NAMES), "image")
        .when(name.rlike(VIDEO_NAMES), "video")
        .when(name.rlike(DOCUMENT_NAMES), "document")
        .otherwise("unsupported")
    )


def is_guide(name: Column) -> Column:
    return name.rlike(GUIDE_NAMES)


def access_decision(tag: Column, unresolved: Column, on_chain: Column, can_access: Column, encrypted: Column, unlock_micros: Column, allowlist: Column, purchasers: Column, wallet: Column, now_micros: Column, broker: bool = False) -> Column:
    """``eligible, needs_broker, needs_decryption, reason`` by the first rule that holds."""

    def said(eligible: bool, reason: str, needs_broker: bool = False, needs_decryption: bool = False) -> Column:
        return F.struct(F.lit(eligible).alias("eligible"), F.lit(needs_broker).alias("needs_broker"), F.lit(needs_decryption).alias("needs_decryption"), F.lit(reason).alias("reason"))

    locked = tag == "time_lock"
    rules = [
        (unresolved, said(False, "unverified")),
        (on_chain & (tag == "public"), said(True, "public")),
        (locked & F.coalesce(unlock_micros, F.lit(0)).eqNullSafe(0), said(False, "no_unlock_time")),
        (locked & (now_micros < unlock_micros), said(False, "locked")),
        (locked & on_chain & can_access.eqNullSafe(False), said(False, "denied")),
        (locked & encrypted, said(False, "encrypted", needs_decryption=True)),
        (locked, said(True, "unlocked")),
        (on_chain & can_access.isNull(), said(False, "unverified")),
        (on_chain & ~can_access, said(False, "denied")),
        (encrypted, said(False, "encrypted", needs_decryption=True)),
        (tag == "public", said(True, "public")),
        (on_chain, said(True, "granted")),
    ]
    if not broker:
        rules.append((F.lit(True), said(False, "no_broker", needs_broker=True)))
    rules += [
        ((tag == "allowlist") & (F.size(allowlist) > 0) & ~F.array_contains(allowlist, wallet), said(False, "not_allowed", needs_broker=True)),
        ((tag == "purchasable") & (F.size(purchasers) > 0) & ~F.array_contains(purchasers, wallet), said(False, "not_purchased", needs_broker=True)),
    ]
    cascade = None
    for holds, result in rules:
        holds = F.coalesce(holds, F.lit(False))
        cascade = F.when(holds, result) if cascade is None else cascade.when(holds, result)
    return cascade.otherwise(said(True, "broker", needs_broker=True))


def sniff(content: Column) -> Column:
    """``kind, mime_type, format`` from the first 16 KiB of binary content, never from a name."""
    sample = F.substring(content, 1, 16384)
    head = F.hex(F.substring(content, 1, 16))
    at = lambda p: F.startswith(head, F.lit(p))
    brand = F.substring(content, 9, 4).cast("string")
    media = F.substring(content, 5, 4) == F.lit(b"ftyp")
    raw = sample.cast("string")
    n = F.greatest(F.octet_length(sample), F.lit(1))
    zeros = F.regexp_count(raw, F.lit(r"\x00"))
    controls = F.regexp_count(raw, F.lit(r"[\x00-\x08\x0e-\x1f]"))
    start = F.regexp_replace(F.substring(raw, 1, 4096), "^\ufeff?[\\s\u00a0\ufeff]*", "")
    said = lambda kind, mime, form: F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime_type"), F.lit(form).alias("format"))
    return (
        F.when(at("255044462D"), said("document", "application/pdf", "PDF"))
        .when(at("89504E470D0A1A0A"), said("image", "image/png", "PNG"))
        .when(at("FFD8FF"), said("image", "image/jpeg", "JPEG"))
        .when(at("47494638"), said("image", "image/gif", "GIF"))
        .when(at("52494646") & (F.substring(content, 9, 4) == F.lit(b"WEBP")), said("image", "image/webp", "WEBP"))
        .when(media & brand.rlike(VIDEO_BRANDS), said("video", "video/mp4", "MP4 VIDEO"))
        .when(media & brand.rlike(STILL_BRANDS) & F.startswith(brand, F.lit("av")), said("unsupported", "image/avif", "AVIF/HEIF"))
        .when(media & brand.rlike(STILL_BRANDS), said("unsupported", "image/heif", "AVIF/HEIF"))
        .when(media, said("unsupported", "application/octet-stream", "ISO MEDIA"))
        .when(at("504B0304"), said("unsupported", "application/zip", "ZIP/OFFICE"))
        .when((zeros / n >= 0.01) | (controls / n >= 0.03), said("unsupported", "application/octet-stream", "BINARY"))
        .when(start.rlike(r"^[\{\[]") & F.get_json_object(content.cast("string"), "$.format").isin(PACKAGE_FORMATS), said("package", "application/json", "PACKAGE"))
        .when(start.rlike(r"^[\{\[]"), said("document", "application/json", "JSON"))
        .when(start.rlike(r"(?i)^(<!doctype\s+html|<html\b)"), said("document", "text/html", "HTML"))
        .when(start.rlike(r"^<\?xml\b"), said("document", "application/xml", "XML"))
        .otherwise(said("document", "text/plain", "TEXT"))
    )

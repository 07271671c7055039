"""SQL fragments that say in DuckDB what :mod:`paperloom.functions.text` says in Spark."""

from __future__ import annotations

from paperloom.functions.text import SHARD_STOP_WORDS, STOP_WORDS, WS

WORD_SPLIT = r"[^\p{L}\p{N}]+"


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def norm(e: str) -> str:
    straight = f"translate(lower({e}), '‘’“”', '''''\"\"')"
    return f"trim(regexp_replace({straight}, '{WS}+', ' ', 'g'), ' ')"


def tokens(e: str, stop: list[str] | None = None) -> str:
    words = f"regexp_split_to_array(strip_accents({norm(e)}), '{WORD_SPLIT}')"
    return f"list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains({quoted(STOP_WORDS if stop is None else stop)}, w))"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'), ' ')"


def quality(e: str) -> str:
    spaced = f"regexp_replace(regexp_replace({e}, 'https?://[^{WS[1:-1]}]+', ' ', 'g'), '\\p{{Cc}}+', ' ', 'g')"
    c = collapse(spaced)
    words = f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]{{2,}}')"
    readable = f"len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}.,;:!?()''\"-]'))"
    return (
        f"CASE WHEN length({c}) < 24 THEN 0.0 ELSE {readable}::DOUBLE / length({c}) * 0.55 "
        f"+ least(1.0, len(list_distinct({words})) / greatest(8.0, len({words}) * 0.35)) * 0.25 + least(1.0, length({c}) / 120.0) * 0.2 END"
    )


SHARD_STOPS = SHARD_STOP_WORDS

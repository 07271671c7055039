"""Queries over questions, made from the conversations' texts and a fixed start by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import intents
from paperloom.plans.registry import query, read

STARTS = [
    "Which page has “a quotation of some length”?", "Find the exact sentence 'a quotation of some length'", "Tell me story number 12", "Who is the author of my book",
    "open notes.pdf and explain", "what can you see in holiday.png", "show my uploaded photos", "How many files do I have, my blobs", "tóm tắt tài liệu", "What is said in this document about",
    "Refresh the list", "hello", "What is my wallet address?", "Số dư ví của tôi", "List all files in my wallet:", "describe the picture", "Của tôi có những tệp nào", "Tóm tắt e\u0301",
    "read the text in this image", "My files?",
]


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_quoted('(?i)' + pattern.replace('{coins}', intents.COINS))})"


_INTENT_SQL = f"""
CASE
  WHEN quoted AND {_has("low", intents.PAGE)} THEN 'page_lookup'
  WHEN quoted AND {_has("low", intents.QUOTE)} THEN 'exact_quote'
  WHEN {_has("low", intents.WALLET_SCOPE)} AND {_has("low", intents.WALLET_FACT)} THEN 'wallet'
  WHEN {_has("low", intents.STORY)} THEN 'story_lookup'
  WHEN (owned OR placed OR named) AND {_has("low", intents.METADATA)} THEN 'metadata'
  WHEN {_has("low", intents.IMAGE_FILE)} THEN 'image'
  WHEN {_has("low", intents.IMAGE_DETAIL)} THEN 'image'
  WHEN images AND {_has("low", intents.IMAGES_HELD)} AND {_has("low", intents.IMAGES_LISTED)} THEN 'image'
  WHEN (owned OR {_has("low", intents.HELD)}) AND {_has("low", intents.INVENTORY)} THEN 'inventory'
  WHEN {_has("low", intents.SUMMARY)} AND (owned OR placed OR {_has("low", intents.SUMMARY_OF)}) THEN 'summarize_study_guide'
  WHEN images AND (owned OR placed OR {_has("low", intents.IMAGES_SHOWN)}) THEN 'image'
  WHEN (owned OR placed) AND {_has("low", intents.ABOUT_TEXT)} THEN 'document_semantic'
  WHEN named AND {_has("low", intents.READ_FILE)} THEN 'document_semantic'
  ELSE 'general'
END
"""


@query(f"""
WITH q AS (SELECT conv_id, turn, [{", ".join(map(_quoted, STARTS))}][((conv_id + turn) % {len(STARTS)})::INTEGER + 1] || ' ' || text AS raw FROM conversations),
l AS (SELECT conv_id, turn, raw, trim(lower(nfc_normalize(raw)), ' ') AS low FROM q),
c AS (SELECT *, regexp_matches(raw, '["''“”‘’][^"''“”‘’]{{8,}}["''“”‘’]') AS quoted, {_has("low", intents.OWNED)} AS owned, {_has("low", intents.LOCATION)} AS placed,
             {_has("raw", intents.FILE)} AS named, {_has("low", intents.IMAGES)} AS images FROM l)
SELECT conv_id, turn, {_INTENT_SQL} AS intent, {_has("raw", intents.REFRESH)} AS refresh,
       CASE WHEN {_has("raw", intents.ALL_FILES)} THEN 'all' WHEN {_has("raw", intents.SOME_FILES)} THEN 'sample' ELSE 'count' END AS detail
FROM c
""")
def p22_p23_query_intent(spark, sf):
    start = F.element_at(F.array(*map(F.lit, STARTS)), ((F.col("conv_id") + F.col("turn")) % len(STARTS) + 1).cast("int"))
    asked = read(spark, sf, "conversations").withColumn("raw", F.concat(start, F.lit(" "), "text"))
    raw = F.col("raw")
    return asked.select("conv_id", "turn", intents.classify(raw).alias("intent"), intents.wants_refresh(raw).alias("refresh"), intents.inventory_detail(raw).alias("detail"))

"""One text for equal JSON values: keys sorted, numbers in one form, no white space; digests are taken of it.

A value is walked level by level: each object or array becomes rows of its members, as VARIANT values, until
only scalars are left; these are written, and the rows are put together again from the deepest level up. A job
per level and direction, whatever the number of values; the parts of one value alone meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import kept

_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"} | {c: f"\\u{c:04x}" for c in range(32) if c not in (8, 9, 10, 12, 13)}


def quoted(text: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters are escaped, nothing else."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escaped(said: Column, codes: list[int]) -> Column:
        for code in codes:
            said = F.replace(said, F.lit(chr(code)), F.lit(_ESCAPES[code]))
        return said

    # most texts have none but white space
    made = F.when(plain.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), escaped(plain, list(_ESCAPES))).when(plain.rlike(r"[\x09\x0a\x0d]"), escaped(plain, [9, 10, 13])).otherwise(plain)
    return F.concat(F.lit('"'), made, F.lit('"'))


def with_number(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the double ``value`` in its one form as ``name``: its digits without an exponent from 1e-6 up to 1e21, minus zero as zero; null if it isn't finite.

    The digits are those of a cast to a string, less the last where it isn't needed to tell the number from others. Each step is a
    column of its own, so that Spark computes it once.
    """
    size, absolute = F.abs(value), F.col("n_size")
    steps = rows.withColumn("n_size", size).withColumn("n_said", F.split(absolute.cast("string"), "E"))
    steps = steps.withColumn("n_halves", F.split(F.get("n_said", F.lit(0)), r"\."))
    steps = steps.withColumn("n_unit", F.coalesce(F.get("n_said", F.lit(1)).cast("int"), F.lit(0)) - F.length(F.get("n_halves", F.lit(1))))
    steps = steps.withColumn("n_digits", F.concat(F.get("n_halves", F.lit(0)), F.get("n_halves", F.lit(1))).cast("bigint"))
    steps = steps.withColumn("n_fewer", F.call_function("div", F.col("n_digits") + 5, F.lit(10)).cast("string"))
    same = (F.col("n_digits") >= 10) & (F.concat("n_fewer", F.lit("E"), (F.col("n_unit") + 1).cast("string")).cast("double") == absolute)
    steps = steps.withColumn("n_same", same).withColumn("n_all", F.when(F.col("n_same"), F.col("n_fewer")).otherwise(F.col("n_digits").cast("string")))
    steps = steps.withColumn("n_point", F.length("n_all") + F.col("n_unit") + F.when(F.col("n_same"), 1).otherwise(0)).withColumn("n_all", F.regexp_replace("n_all", "0+$", ""))
    digits, point, n = F.col("n_all"), F.col("n_point"), F.length("n_all")
    rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit(""))
    shown = (
        F.when((n <= point) & (point <= 21), F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(F.concat(F.substring(digits, 1, 1), rest, F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string")))
    )
    finite = ~F.isnan("n_size") & (absolute < float("inf"))
    made = F.when(absolute == 0, "0").when(finite, F.concat(F.when(F.col(value) < 0, "-").otherwise(""), shown))
    return steps.withColumn(name, made).drop("n_size", "n_said", "n_halves", "n_unit", "n_digits", "n_fewer", "n_same", "n_all", "n_point")


def canonical_json(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, canonical`` of each row's JSON text in ``value``; null where it isn't JSON, repeats a key of an object or has a number that isn't finite.

    Keys are ordered by their UTF-16 code units. ``key`` names each row once.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("id"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(value).alias("v"))
    levels = []
    while True:
        kind, text = F.col("kind"), F.col("text")
        level = level.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)).withColumn("text", F.when(kind.isin("STRING", "BOOLEAN"), F.variant_get("v", "$", "string")))
        level = with_number(level.withColumn("x", F.when(~kind.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID"), F.try_variant_get("v", "$", "double"))), "x", "number")
        scalar = (
            F.when(kind == "VOID", "null")
            .when(kind == "BOOLEAN", text)
            .when(kind == "STRING", quoted(text))
            .otherwise(F.col("number"))
        )
        level = kept(level.select("id", "path", "name", F.when(kind.isin("OBJECT", "ARRAY"), F.col("v")).alias("v"), "kind", scalar.alias("said")), "json-level")
        if levels and level.isEmpty():
            break
        levels.append(level.drop("v"))
        level = spark.sql("SELECT l.id, array_append(l.path, m.pos) AS path, m.key AS name, m.value AS v FROM {level} l, LATERAL variant_explode(l.v) m WHERE l.kind IN ('OBJECT', 'ARRAY')", level=level)
    made = levels[-1].select("id", "path", "name", F.coalesce("said", F.when(F.col("kind") == "OBJECT", "{}").when(F.col("kind") == "ARRAY", "[]")).alias("said"))
    for above in reversed(levels[:-1]):
        member = F.when(F.col("name").isNull(), F.col("said")).otherwise(F.concat(quoted(F.col("name")), F.lit(":"), F.col("said")))
        order = F.when(F.col("name").isNull(), F.encode(F.lpad(F.element_at("path", -1).cast("string"), 10, "0"), "UTF-16BE")).otherwise(F.encode("name", "UTF-16BE"))
        parts = made.select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct(order.alias("o"), member.alias("m")).alias("part"), member.isNull().alias("bad"))
        joined = parts.groupBy("id", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["m"]), ",").alias("inner"), F.max("bad").alias("bad"))
        met = above.join(joined, ["id", "path"], "left")
        inner = F.when(~F.coalesce("bad", F.lit(False)), F.coalesce("inner", F.lit("")))
        said = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), inner, F.lit("}"))).when(F.col("kind") == "ARRAY", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("said"))
        made = met.select("id", "path", "name", said.alias("said"))
    return made.select(F.col("id").alias(key), F.col("said").alias("canonical"))

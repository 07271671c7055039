"""Vector functions on arrays of numbers. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is empty; a zero norm divides by one."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = dot(a, b) / F.when(norms == 0, 1.0).otherwise(norms)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), value).otherwise(0.0)


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, even where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return once(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def quantize(v: Column) -> Column:
    """``scale`` and ``codes`` (1 to 255, half rounds up) of the unit vector."""

    def codes(q: Column) -> Column:
        rounded = F.transform(q["unit"], lambda x: F.greatest(F.lit(1), F.least(F.lit(255), F.floor(x / q["scale"] + 0.5) + 128)).cast("int"))
        return F.struct(q["scale"].alias("scale"), rounded.alias("codes"))

    def scaled(unit: Column) -> Column:
        scale = F.greatest(F.lit(1e-6), F.array_max(F.transform(unit, lambda x: F.abs(x)))) / 127
        return F.struct(unit.alias("unit"), scale.alias("scale"))

    return once(once(l2_normalize(v), scaled), codes)


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (c - 128) * q["scale"])

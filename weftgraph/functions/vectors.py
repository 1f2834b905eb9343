"""Vector expressions: higher-order functions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalized(a: Column) -> Column:
    """Divided by the length; values that aren't finite count as 0, and a vector
    of hardly any length stays as it is."""
    clean = F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0.0)).otherwise(x.cast("double")))
    size = F.sqrt(_sum(F.transform(clean, lambda x: x * x)))
    return F.when(size > 1e-12, F.transform(clean, lambda x: x / size)).otherwise(clean)


def problem(a: Column, length: int) -> Column:
    """What is wrong with a vector: null if nothing is."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(a.isNull() | (F.size(a) != length), "length").when(~finite, "not finite").when(F.forall(a, lambda x: x == 0), "zero")

"""Vector functions over ``array<float>`` or ``array<double>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalize(a: Column) -> Column:
    """To unit length; a zero vector stays."""
    size = norm(a)
    by = F.when(size == 0, 1.0).otherwise(size)
    return F.transform(a, lambda x: x.cast("double") / by)


def truncate(a: Column, dimensions: int) -> Column:
    """The first dimensions, brought to unit length again."""
    return normalize(F.slice(a, 1, dimensions))

"""Complex numbers as (re, im) columns; Spark has no complex type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def times(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conjugate(a: Pair) -> Pair:
    return a[0], -a[1]


def squared(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def over(a: Pair, b: Pair) -> Pair:
    re, im = times(a, conjugate(b))
    return re / squared(b), im / squared(b)


def phase(angle: Column) -> Pair:
    return F.cos(angle), F.sin(angle)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

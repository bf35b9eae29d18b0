"""Cosine distance over arrays, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either is null or has no length."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(vector: Column) -> Column:
    """The vector at length 1; null if it is null, has no length or isn't finite."""
    v = vector.cast("array<double>")
    size = norm(v)
    sizes = F.array_repeat(size, F.size(v))  # inside a lambda it would be worked out for each number
    return F.when((size > 0) & (size < float("inf")), F.zip_with(v, sizes, lambda x, s: x / s))


def rendered(a: Column, digits: int = 6) -> Column:
    """A query vector as it is after being written out with so many decimals."""
    return F.transform(a.cast("array<double>"), lambda x: F.round(x, digits))

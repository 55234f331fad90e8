"""Vectors as arrays of floats, computed in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; null with a zero vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths)


def literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])

"""Vectors as arrays; sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Null where sizes differ or a vector is null."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), s)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))


def drifted(a: Column, b: Column, most: float = 0.4) -> Column:
    """Whether two unit vectors point away from each other; empty or mismatched ones have not."""
    return F.coalesce((F.size(a) > 0) & (1 - dot(a, b) > most), F.lit(False))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))

"""Array-of-number expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2n(v: Column, eps: float = 1e-8) -> Column:
    """Unit vector; ``eps`` keeps a zero vector at zero."""
    length = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))


def squared_distance(a: Column, b: Column) -> Column:
    """Between unit vectors this equals 2 - 2 cos."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x * x)

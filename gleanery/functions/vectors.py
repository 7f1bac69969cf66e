"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors and nulls."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def truncate(a: Column, dim: int) -> Column:
    """The first dim entries, scaled to length 1 if that is possible."""
    head = F.transform(F.slice(a, 1, dim), lambda x: x.cast("double"))
    size = norm(head)
    return F.when(F.size(a) <= dim, F.transform(a, lambda x: x.cast("double"))).when(size > 0, F.transform(head, lambda x: x / size)).otherwise(head)


def blend(query: Column, other: Column, weight: float) -> Column:
    """weight * other + (1 - weight) * query, scaled to length 1."""
    mixed = F.zip_with(query, other, lambda q, h: h.cast("double") * weight + q.cast("double") * (1 - weight))
    return F.transform(mixed, lambda x: x / (norm(mixed) + 1e-8))

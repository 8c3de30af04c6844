"""Column functions on ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """The vector divided by its norm, NULL for the zero vector."""
    return F.transform(F.array(F.nullif(norm(v), F.lit(0.0))), lambda n: F.when(n.isNotNull(), F.transform(v, lambda x: x / n)))[0]


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """Negative Euclidean distance."""
    return -euclidean_distance(a, b)


def weighted_cosine_similarity(a: Column, b: Column, w: Column) -> Column:
    """Cosine after both vectors were multiplied by the weights of the dimensions."""
    scale = lambda v: F.zip_with(v, w, lambda x, y: x * y)
    return cosine_similarity(scale(a), scale(b))

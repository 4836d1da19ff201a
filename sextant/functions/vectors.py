"""Similarities of array<float> columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCES = ("cosine", "dot", "euclid", "manhattan")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.when(size == 0, F.lit(0.0)))


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over query token vectors of the best dot product with a document token vector."""
    return _sum(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))))

"""Distances as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this product of norms vectors count as orthogonal.
TINY = 1.1920929e-7
METRICS = ("cosine", "euclidean", "hamming")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(each: Column) -> Column:
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm <= TINY, 1.0).otherwise(1 - dot(a, b) / norm)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def hamming(a: Column, b: Column) -> Column:
    """In how many places the signs differ."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when((x >= 0) != (y >= 0), 1.0).otherwise(0.0)))

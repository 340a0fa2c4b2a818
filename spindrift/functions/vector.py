"""Vector arithmetic as columns. Vectors are arrays of numbers; all sums are in double precision.

A zero norm gives null, which rankings leave out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "manhattan": manhattan, "cosine_distance": lambda a, b: 1 - cosine(a, b)}


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return METRICS[metric](a, b)


def normalized(v: Column) -> Column:
    """Unit vector; null for the zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(_double(v), lambda x: F.try_divide(x, n)))


def decay_weights(n: Column) -> Column:
    """1 - i / n for the places of a sequence of n."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: 1 - i / n)


def fused(vectors: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of the vectors that are there; null if none is."""
    total = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in zip(vectors, weights, strict=True)), F.lit(0.0))

    def times(v: Column, w: float) -> Column:
        return F.coalesce(F.transform(_double(v), lambda x: x * F.lit(float(w))), F.array())

    scaled = [times(v, w) for v, w in zip(vectors, weights, strict=True)]
    out = scaled[0]
    for v in scaled[1:]:
        out = F.zip_with(out, v, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.when(total > 0, F.transform(out, lambda x: F.try_divide(x, total)))

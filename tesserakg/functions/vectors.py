"""Functions on columns of numbers: products, distances, activations. Nulls give null; vectors must have one length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_vector(column: str, size: int) -> Column:
    """Aggregate: the mean of vectors of one length, element by element."""
    return F.array(*(F.avg(F.get(column, i)) for i in range(size)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(values: Column) -> Column:
    """Of an array; the largest value is taken off first."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """Place (from 0) of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def path_weight(score: Column) -> Column:
    """Cost of a score on a path: sums of costs are products of scores."""
    return -F.log2(score)


def path_score(weight: Column) -> Column:
    return F.pow(F.lit(2.0), -weight)


def clamped(score: Column, low: float = 1e-6, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)

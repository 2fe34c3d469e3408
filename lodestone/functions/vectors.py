"""Dense, sparse and multi-vector similarity as column expressions (doubles throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import held


def _zero() -> Column:
    return F.lit(0.0)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null for vectors of different length."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _zero(), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.when(n == 0, _zero()))


def unit(v: Column) -> Column:
    """L2 normalisation; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def max_normalised(weights: Column) -> Column:
    """A sparse map scaled so that its greatest weight is 1; empty or non-positive maps stay."""

    def scaled(m: Column) -> Column:
        return held(F.array_max(F.map_values(m)), lambda top: F.when(top > 0, F.transform_values(m, lambda _, w: w / top)).otherwise(m))

    return held(weights, scaled)


def slices(v: Column, width: int, parts: int) -> Column:
    """A vector cut into `parts` vectors of `width`."""
    return F.array(*(F.slice(v, 1 + k * width, width) for k in range(parts)))


def maxsim(query: Column, doc: Column, mean: bool = False) -> Column:
    """Sum (or mean) over the query's vectors of the greatest inner product with a vector of the document."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    total = F.aggregate(best, _zero(), lambda s, x: s + F.coalesce(x, _zero()))
    return total / F.size(query) if mean else total


def mean_pool(vectors: Column, width: int) -> Column:
    """Element-wise mean of a multi-vector."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(vectors, _zero(), lambda s, v: s + v[i]) / F.size(vectors))


def blended(dense: Column, sparse: Column, multi: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """Weighted score; weights are scaled to sum to 1."""
    total = sum(weights)
    a, b, c = (w / total for w in weights)
    return dense * a + sparse * b + multi * c

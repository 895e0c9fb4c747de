"""Dense vectors held in arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for a zero or missing vector."""
    length = norm(a) * norm(b)
    return F.coalesce(F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / length))), F.lit(0.0))


def mean_vector(vectors: list[Column]) -> Column:
    """Mean of word vectors, given as columns."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(vectors))

"""Similarity of sets held in arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the union; 0 where either set is empty or missing. Null elements don't count."""
    a, b = F.array_compact(a), F.array_compact(b)
    shared = F.size(F.array_intersect(a, b))
    empty = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(shared / F.size(F.array_union(a, b)))

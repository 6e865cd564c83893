"""Exact set similarity as a Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alike(a: Column, b: Column, jaccard: float) -> Column:
    """Whether two sets reach the Jaccard similarity: ``both / (a + b - both) >= j``, solved for
    ``both``, so that a filter computes the intersection once and only for sets of like sizes."""
    near = F.least(F.size(a), F.size(b)) >= F.lit(jaccard) * F.greatest(F.size(a), F.size(b)) - 1e-9
    return near & (F.size(F.array_intersect(a, b)) >= F.lit(jaccard / (1 + jaccard)) * (F.size(a) + F.size(b)) - 1e-9)

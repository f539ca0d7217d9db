"""Columns over colour histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def histogram_entropy(h: Column) -> Column:
    """Shannon entropy in nats over all bins together; null when there is no histogram."""
    total = _total(h)
    terms = F.transform(h, lambda x: F.when(x > 0, (x / total) * F.ln(x / total)).otherwise(F.lit(0.0)))
    return F.when(F.size(h) > 0, F.when(total > 0, -_total(terms)).otherwise(F.lit(0.0)))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Intersection averaged over the three channels."""
    return _total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / F.lit(3.0)

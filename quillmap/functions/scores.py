"""Numeric helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def citation_size(citations: Column, max_citations: Column, a: float, b: float) -> Column:
    """Relative weight of a paper: log citations over the largest log citations, scaled to a, b."""
    top = F.greatest(F.log1p(max_citations), F.lit(1.0))
    return F.log1p(citations) / top * a + b


def collaboration_score(
    shared: Column,
    recency: Column,
    total_a: Column,
    total_b: Column,
    weights: tuple[float, float, float] = (0.4, 0.35, 0.25),
) -> Column:
    """Weighted frequency, recency and overlap of two authors."""
    w_freq, w_recent, w_overlap = weights
    joint = F.greatest(total_a + total_b - shared, F.lit(1))
    return (
        w_freq * F.log1p(shared)
        + w_recent * F.coalesce(recency, F.lit(0.0))
        + w_overlap * shared / joint
    )

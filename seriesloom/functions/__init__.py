"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """Division in which a zero denominator gives 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def nan_to_null(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column, places: int) -> Column:
    """Rounding that keeps the sign of what becomes 0, as SQL engines do; Spark's own gives 0.0 for -0.00001. Arrays of such values compare by it."""
    near = F.round(c, places)
    return F.when((near == 0) & (c < 0), F.lit(-0.0)).otherwise(near)

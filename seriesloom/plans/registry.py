"""All queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import aggregating, filtering, joining, judging, plugging, reading, shaping, timing, windowing  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of sliding windows over the event series."""
    return QUERIES["agg17_window_statistics"](spark, sf_dir)

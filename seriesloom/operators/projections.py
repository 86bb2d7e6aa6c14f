"""Column roles, candidate columns and leaked covariates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def infer_roles(df: DataFrame, ts: str | None = None, groups: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Numeric columns are continuous, the others discrete; timestamp and group columns are neither."""
    rest = [(c, t) for c, t in df.dtypes if c != ts and c not in groups and not c.startswith("_")]
    return {"continuous": [c for c, t in rest if t in NUMERIC], "discrete": [c for c, t in rest if t not in NUMERIC]}


def timestamp_candidates(df: DataFrame, most_null: float = 0.1) -> DataFrame:
    """String and time columns of which at most a share does not parse, one row each."""
    text = [c for c, t in df.dtypes if t == "string" or t.startswith(("timestamp", "date"))]
    shares = df.agg(*[F.avg(F.try_to_timestamp(F.col(c).cast("string")).isNull().cast("double")).alias(c) for c in text])
    long = shares.unpivot([], text, "column", "null_share")
    return long.where(F.col("null_share") <= most_null)


def categories(df: DataFrame, most: int = 100) -> DataFrame:
    """Distinct values of text columns and of numeric columns with at most `most` values: (column, value)."""
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if kinds[c] == "string" or kinds[c] in NUMERIC]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    values = long.distinct()
    stats = values.groupBy("column").agg(F.count("*").alias("_n"), F.bool_and(F.expr("try_cast(value as double) is not null")).alias("_num"))
    good = stats.where((~F.col("_num")) | (F.col("_n") <= most)).select("column")
    return values.join(good, "column", "left_semi")


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column, n, invariant): how many different values each column has."""
    one = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "n").withColumn("invariant", F.col("n") <= 1)


def date_column(df: DataFrame) -> str | None:
    """By name first, then by type."""
    named = [c for c in df.columns if re.search(r"date|time|timestamp|(^|_)ts$", c.lower())]
    typed = [c for c, t in df.dtypes if t.startswith(("timestamp", "date"))]
    return next(iter([*named, *typed]), None)


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Configured columns that are absent, as zeros."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})


def without_generated(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Without columns that have a generated prefix or are called <column>_lag_<n>."""
    return df.drop(*[c for c in df.columns if c.startswith(prefixes) or re.fullmatch(r".+_lag_\d+", c)])


def unique_names(df: DataFrame) -> DataFrame:
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, -1) + 1
        names.append(c if not seen[c] else f"{c}_{seen[c]}")
    return df.toDF(*names)


def hide_future(df: DataFrame, future: str, covariates: list[str], leaked: list[str]) -> DataFrame:
    """Future values of covariates that are not leaked become null."""
    if not set(leaked) <= set(covariates):
        raise ValueError("only covariates can be leaked")
    return df.withColumns({c: F.when(~F.col(future), F.col(c)) for c in covariates if c not in leaked})

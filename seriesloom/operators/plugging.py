"""Where users plug in their own steps: feature chains, grouped functions and forecasters.

Steps of a chain and grouped functions stay expressions, so Catalyst sees
through them. A forecaster of the user's own runs in pandas on one series at a
time, which is the unit that its interface has."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Step = Callable[[DataFrame], DataFrame]
Forecaster = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def feature_chain(df: DataFrame, steps: list[Step]) -> DataFrame:
    """The steps in order, each from a frame to a frame that has at least its columns."""

    def one(done: DataFrame, step: Step) -> DataFrame:
        out = step(done)
        lost = [c for c in done.columns if c not in out.columns]
        if lost:
            raise ValueError(f"a feature step dropped {lost}")
        return out

    return reduce(one, steps, df)


def by_group(df: DataFrame, keys: list[str], functions: dict[str, Column | Callable[[str], Column]], value: str = "value") -> DataFrame:
    """One row per group with a column per named aggregate: an expression, or a function of the value column's name."""
    return df.groupBy(*keys).agg(*[(f if isinstance(f, Column) else f(value)).alias(n) for n, f in functions.items()])


def forecast_with(history: DataFrame, future: DataFrame, keys: list[str], model: Forecaster, schema: StructType | str) -> DataFrame:
    """`model(history rows, future rows)` for each series that has future rows; the history is empty where there is none.

    Both frames are shuffled by the series keys once; a task holds one series."""
    asked = future.select(*keys).distinct()
    known = history.join(asked, keys, "left_semi").select(*[F.col(c).alias(c) for c in history.columns])  # both frames may come from one table

    def one(key: tuple, past: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        return model(past, ahead)

    return known.groupBy(*keys).cogroup(future.groupBy(*keys)).applyInPandas(one, schema)


def last_value(keys: list[str], order: list[str], value: str, n: int = 1) -> Forecaster:
    """A forecaster that repeats the mean of the last `n` values; null without history."""

    def model(past: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        tail = past.sort_values(order)[value].tail(n)
        return ahead[[*keys, *order]].assign(forecast=tail.mean() if len(tail) else None).astype({"forecast": "float64"})

    return model


def lag_step(keys: list[str], order: list[str], column: str, size: int) -> Step:
    from .windows import lag_or_zero

    return lambda df: lag_or_zero(df, keys, order, column, size)


def calendar_step(ts: str) -> Step:
    return lambda df: df.withColumns({"hour": F.hour(ts), "weekday": F.weekday(ts)})

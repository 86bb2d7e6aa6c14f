"""What-if edits: perturbing columns fully, by range, by point, or over a grid."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
INFINITE = float("inf")


def perturbed(df: DataFrame, column: str, how: str, by: float, over_zero: float | None = None) -> Column:
    """add, subtract, multiply or divide; division by 0 gives an infinity of the value's sign, or NaN for 0; `over_zero` stands for it in every row, whatever the value and where it is missing."""
    if dict(df.dtypes)[column] not in NUMERIC:
        raise ValueError(f"{column} is not numeric")
    c = F.col(column).cast("double")
    if how == "divide" and by == 0:
        return F.lit(float(over_zero)) if over_zero is not None else F.when(c > 0, F.lit(INFINITE)).when(c < 0, F.lit(-INFINITE)).when(c == 0, F.lit(float("nan")))
    return {"add": c + by, "subtract": c - by, "multiply": c * by, "divide": c / (by or 1)}[how]


def exact(df: DataFrame, column: str, value: object) -> Column:
    """One value for the whole column; its type must match."""
    numeric = dict(df.dtypes)[column] in NUMERIC
    if numeric != isinstance(value, int | float):
        raise ValueError(f"{value!r} does not fit {column}")
    return F.lit(value).cast(dict(df.dtypes)[column])


def apply_edits(df: DataFrame, ts: str, edits: list[dict]) -> DataFrame:
    """Edits in `order`, each for the whole table or an inclusive time range: {column, how, value, start, end, order}."""
    for e in sorted(edits, key=lambda e: e["order"]):
        new = exact(df, e["column"], e["value"]) if e["how"] == "set" else perturbed(df, e["column"], e["how"], e["value"])
        if e.get("start") is not None:
            inside = F.col(ts).between(F.lit(e["start"]).cast("timestamp_ntz"), F.lit(e["end"]).cast("timestamp_ntz"))
            new = F.when(inside, new).otherwise(F.col(e["column"]))
        df = df.withColumn(e["column"], new)
    return df


def edit_grid(windows: DataFrame, factors: list[float], column: str, n: int | None = None) -> DataFrame:
    """Every factor of an edit grid copies the windows where they are; new_idx is the factor's place (combo) * n + window.

    Without n, it is one above the greatest window number of the table; a window number of n or more is an error."""
    top = windows.agg((F.max("window_idx") + 1).cast("long").alias("_n"))  # one row
    if n is not None:
        top = top.withColumn("_n", F.when(F.col("_n") > n, F.raise_error(F.lit("a window number is n or more")).cast("long")).otherwise(F.lit(n)))
    copies = windows.select("*", F.posexplode(F.array(*map(F.lit, factors))).alias("combo", "factor")).join(F.broadcast(top))
    return copies.withColumn(column, F.col(column) * F.col("factor")).withColumn("new_idx", F.col("combo") * F.col("_n") + F.col("window_idx")).drop("_n")


def filter_combinations(values: DataFrame) -> DataFrame:
    """One row per combination of one value per column, from (column, value) rows, with no bound on columns.

    The lists of values are one row (the result is as many rows as their sizes multiplied), which grows column by column."""
    names = [r[0] for r in values.select("column").distinct().orderBy("column").collect()]  # names of columns
    lists = values.groupBy().pivot("column", names).agg(F.collect_set("value"))
    for i, name in enumerate(names):
        lists = lists.withColumn(name, F.explode(F.col(f"`{name}`")))
        if i + 1 < len(names):
            lists = lists.repartition(F.col(f"`{name}`"))
    return lists


def covariate_subsets(columns: list[str], most: int) -> list[tuple[str, ...]]:
    """Subsets by size up to `most`, the empty one first."""
    return [c for k in range(most + 1) for c in combinations(columns, k)]


def zeroed_tail(array: str, n: int) -> Column:
    """The last n values moved out: zeros at the end in their place."""
    kept = F.slice(F.col(array), 1, F.greatest(F.size(array) - n, F.lit(0)))
    return F.concat(kept, F.array_repeat(F.lit(0.0), n))


def constrained(df: DataFrame, limits: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Values cut to the limits (low, high) of their key; low above high is an error."""
    joined = df.join(limits, keys)
    low = F.when(F.col("low") > F.col("high"), F.raise_error(F.lit("low is above high")).cast("double")).otherwise(F.col("low"))
    return joined.withColumn(column, F.least(F.col("high"), F.greatest(low, F.col(column)))).drop("low", "high")


def extreme_steps(df: DataFrame, keys: list[str], column: str, step: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(step, F.struct(column, step)).alias("argmin"), F.max_by(step, F.struct(F.col(column), -F.col(step))).alias("argmax"))

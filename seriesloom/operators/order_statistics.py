"""Exact quantiles and modes of groups of any size.

A sketch brackets each wanted rank; rows below the bracket are only counted,
and only the few values inside it are ordered. So no task holds the values of
a whole large group, and the result is exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY, MARGIN, SMALL = 10_000, 5, 10_000
#: A table of at most so many groups is worked out first and broadcast.
FEW = 4096


def by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; without keys, `right` has one row."""
    if not keys:
        return left.join(F.broadcast(right))
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def settled(groups: DataFrame, few: int = FEW) -> DataFrame:
    """A table of one row per group, worked out first: with few rows it is broadcast, so that a join with it moves no other row and a large group stays spread."""
    if any(isinstance(f.dataType, T.TimestampType) for f in groups.schema):  # a local time that occurs twice does not come back as it was
        return groups
    taken = groups.limit(few + 1).collect()
    return groups if len(taken) > few else F.broadcast(groups.sparkSession.createDataFrame(taken, groups.schema))


def quantiles_of(df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per name in `shares`): exact quantiles with linear interpolation; a group without values has no row."""
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null")
    names, reach = list(shares), MARGIN / ACCURACY
    edges = [e for q in shares.values() for e in (max(0.0, q - reach), min(1.0, q + reach))]
    groups = rows.groupBy(*keys).agg(F.percentile_approx("_v", edges, ACCURACY).alias("_e"), F.count("*").alias("_all"))
    # In a group of at least SMALL rows a bracket is wider than one rank to both sides; of a smaller one, all values lie in the bracket.
    edges_of = F.when(F.col("_all") >= SMALL, F.col("_e")).otherwise(F.array(*[F.lit(x) for _ in names for x in (float("-inf"), float("inf"))]))
    groups = settled(groups.withColumn("_e", edges_of))
    placed = by_keys(rows, groups, keys)
    low, high = [F.col("_e")[2 * i] for i in range(len(names))], [F.col("_e")[2 * i + 1] for i in range(len(names))]
    near = [(F.col("_v") >= a) & (F.col("_v") <= b) for a, b in zip(low, high, strict=True)]
    # One pass counts the rows by the brackets that they lie below, and those inside a bracket by their value as well.
    under = reduce(lambda a, b: a + b, [F.when(F.col("_v") < e, 1 << i).otherwise(0) for i, e in enumerate(low)])
    cells = placed.groupBy(*keys, under.alias("_u"), F.when(reduce(lambda a, b: a | b, near), F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    cells = by_keys(cells, groups, keys)
    below = cells.groupBy(*keys).agg(*[F.sum(F.when(F.col("_u").bitwiseAND(1 << i) != 0, F.col("_n")).otherwise(0)).alias(f"_b{i}") for i in range(len(names))], F.any_value("_all").alias("_all"))
    which = F.filter(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(near)]), lambda i: i.isNotNull())
    counts = cells.where("_v is not null").select(*keys, "_v", "_n", F.explode(which).alias("_i"))  # a row per value and bracket: copies of a value are counted in all of its brackets
    running = counts.withColumn("_c", F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    met = by_keys(running, below, keys)
    at = {name: F.lit(q) * (F.col("_all") - 1) for name, q in shares.items()}
    first = lambda i, rank: F.min(F.when((F.col("_i") == i) & (F.col("_c") + F.col(f"_b{i}") > rank), F.col("_v")))
    found = met.groupBy(*keys).agg(
        F.any_value("_all").alias("_all"), *[first(i, F.floor(at[n])).alias(f"_l{i}") for i, n in enumerate(names)], *[first(i, F.ceil(at[n])).alias(f"_h{i}") for i, n in enumerate(names)]
    )
    part = {n: at[n] - F.floor(at[n]) for n in names}
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    whole = {n: F.coalesce(F.col(f"_l{i}") * (1 - part[n]) + F.col(f"_h{i}") * part[n], missed) for i, n in enumerate(names)}
    return found.select(*keys, *[whole[n].alias(n) for n in names])


def with_quantiles(aggregated: DataFrame, df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """An aggregate of `df` by `keys` with exact quantiles beside it."""
    return by_keys(aggregated, quantiles_of(df, keys, value, shares), keys, "left" if keys else "inner")


def mode_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the most frequent value of each group, the smallest of ties; counts combine before the shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(name))


def dense_rank_of_text(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct texts with their rank from 1: counts by buckets of about equally many texts first, then the order inside a bucket."""
    from .scans import positioned

    each = df.select(column).where(F.col(column).isNotNull()).distinct()
    return positioned(each, [], [column], "_p").select(column, (F.col("_p") + 1).cast("long").alias(name))

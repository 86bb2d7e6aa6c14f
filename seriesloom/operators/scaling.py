"""Cleaning, scaling and encoding. Fitted parameters are tables that join back, so any number of groups works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import running_total
from .order_statistics import by_keys, quantiles_of, settled


def clipped(df: DataFrame, columns: list[str], k: float = 5.0) -> DataFrame:
    """Values cut to the column's mean +- k population deviations."""
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    cut = {c: F.greatest(F.col(f"_m_{c}") - k * F.col(f"_s_{c}"), F.least(F.col(f"_m_{c}") + k * F.col(f"_s_{c}"), F.col(c))) for c in columns}
    return df.join(F.broadcast(one)).withColumns(cut).select(*df.columns)  # one row


def last_of_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in order; an aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def reject_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as they are; a key that occurs twice is an error when rows are read."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    fine = counts.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate keys"))).otherwise(F.lit(1)))
    return df.join(fine, keys).where("_ok = 1").select(*df.columns)


def coerced(df: DataFrame, column: str) -> DataFrame:
    """Text that does not parse as a number goes."""
    return df.withColumn(column, F.expr(f"try_cast(`{column}` as double)")).dropna(subset=[column])


def fit_scaler(long: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, centre, scale) of none, standard, minmax or robust; a zero scale is 1."""
    if kind == "robust":
        fitted = quantiles_of(long, keys, "value", {"_q25": 0.25, "centre": 0.5, "_q75": 0.75}).withColumn("_s", F.col("_q75") - F.col("_q25"))
    else:
        centre, scale = {"none": (F.lit(0.0), F.lit(1.0)), "standard": (F.avg("value"), F.stddev_pop("value")), "minmax": (F.min("value"), F.max("value") - F.min("value"))}[kind]
        fitted = long.groupBy(*keys).agg(F.first(F.lit(1)).alias("_1"), centre.alias("centre"), scale.alias("_s"))
    return fitted.select(*keys, "centre", F.coalesce(F.nullif(F.col("_s"), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def fit_scalers(long: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """(kind, keys, centre, scale) for several kinds: one aggregate gives all but robust ones, one pass of quantiles those. A group without values has no robust row."""
    plain = {"none": (F.lit(0.0), F.lit(1.0)), "standard": (F.col("_avg"), F.col("_std")), "minmax": (F.col("_lo"), F.col("_hi") - F.col("_lo"))}
    asked = [k for k in kinds if k in plain]
    one = long.groupBy(*keys).agg(F.avg("value").alias("_avg"), F.stddev_pop("value").alias("_std"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), plain[k][0].cast("double").alias("centre"), plain[k][1].cast("double").alias("_s")) for k in asked])
    out = one.select(*keys, F.explode(rows).alias("_r")).select("_r.kind", *keys, "_r.centre", F.coalesce(F.nullif(F.col("_r._s"), F.lit(0.0)), F.lit(1.0)).alias("scale")) if asked else None
    if "robust" not in kinds:
        return out
    robust = fit_scaler(long, keys, "robust").select(F.lit("robust").alias("kind"), *keys, "centre", "scale")
    return robust if out is None else out.unionByName(robust)


def apply_scaler(long: DataFrame, scaler: DataFrame, keys: list[str], invert: bool = False) -> DataFrame:
    """Scaled or restored values; a key without parameters is an error."""
    joined = long.join(scaler, keys, "left")
    scale = F.when(F.col("scale").isNull(), F.raise_error(F.lit("no scaler for a label")).cast("double")).otherwise(F.col("scale"))
    value = F.col("value") * scale + F.col("centre") if invert else (F.col("value") - F.col("centre")) / scale
    return joined.withColumn("value", value).drop("centre", "scale")


def window_standardized(df: DataFrame, keys: list[str], column: str, fill: float) -> Column:
    w = Window.partitionBy(*keys)
    return F.coalesce((F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_pop(column).over(w), F.lit(0.0)), F.lit(fill))


def normalized_score(keys: list[str], column: str) -> Column:
    """z-score with 1e-6 added to the sample deviation; a constant score is unchanged."""
    w = Window.partitionBy(*keys)
    s = F.stddev_samp(column).over(w)
    return F.when(s > 0, (F.col(column) - F.avg(column).over(w)) / (s + 1e-6)).otherwise(F.col(column))


def range_scaled(df: DataFrame, keys: list[str], actual: str, **columns: str) -> DataFrame:
    """`df` with each name=column scaled by the range of the actual one in its group. Ranges are a table of groups, so no task holds a whole one."""
    ends = settled(df.groupBy(*keys).agg(F.min(actual).alias("_lo"), F.max(actual).alias("_hi")))
    met = by_keys(df, ends, keys)
    return met.withColumns({name: F.try_divide(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")) for name, c in columns.items()}).drop("_lo", "_hi")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column per value; others are all zero."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})


def from_one_hot(column: str, values: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col(f"{column}_{v}") == 1, F.lit(v)) for v in values])


def codes_by_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """Integer codes in order of first appearance by the numeric column `order`, -1 for null; the distinct values are ranked in two steps, by buckets and inside them."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_f")).withColumn("_one", F.lit(1))
    codes = running_total(first, "_f", "_one", "_place").select(column, (F.col("_place") - 1).alias(f"{column}_code"))
    return df.join(codes, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)))


def invariant_windows(windows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per window the columns' first values and whether each has one value only."""
    return windows.groupBy(*keys).agg(*[F.min_by(c, "step").alias(c) for c in columns], *[(F.count_distinct(c) <= 1).alias(f"{c}_constant") for c in columns])

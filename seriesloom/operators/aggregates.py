"""Aggregates: duplicate timestamps, column statistics, summaries and roll-ups.

Statistics of many columns run on the long form (column, value), so their
number of columns does not change the plan; partial aggregation happens
before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import gaps
from .order_statistics import by_keys, mode_of, quantiles_of, with_quantiles
from .scans import running_sum

AGGREGATES = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "min": F.min, "max": F.max}


def merge_repeated(df: DataFrame, ts: str, keys: list[str], how: str, numeric: list[str], text: list[str]) -> DataFrame:
    """One row per timestamp and keys, by sum, mean, min, max, median or mode; text that differs inside a group is an error. Rows with a null key go."""
    known = df.dropna(subset=[ts, *keys])
    by_order = {c: {"median": lambda c: quantiles_of(known, [ts, *keys], c, {c: 0.5}), "mode": lambda c: mode_of(known, [ts, *keys], c, c)}[how](c) for c in numeric} if how in ("median", "mode") else {}
    out = known.groupBy(ts, *keys).agg(F.count("*").alias("_rows"), *[AGGREGATES[how](c).alias(c) for c in numeric if c not in by_order], *[F.any_value(c).alias(c) for c in text], *[F.min(c).eqNullSafe(F.max(c)).alias(f"_{c}") for c in text])
    for one in by_order.values():
        out = by_keys(out, one, [ts, *keys], "left")
    checks = [F.when(~F.col(f"_{c}"), F.raise_error(F.lit(f"{c} differs inside a group"))).otherwise(F.col(c)).alias(c) for c in text]
    return out.select(ts, *keys, *numeric, *checks)


def long_form(df: DataFrame, columns: list[str], ids: tuple[str, ...] = ()) -> DataFrame:
    """(ids, column, value double), without nulls and NaN."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), columns, "column", "value").where("value is not null and not isnan(value)")


def basic_statistics(long: DataFrame, keys: list[str]) -> DataFrame:
    """Population statistics; skewness below 3 and kurtosis below 4 values, and without variance, are 0."""
    one = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("_skew"), F.kurtosis("value").alias("_kurt"),
    )
    one = with_quantiles(one, long, keys, "value", {"median": 0.5})
    flat = F.col("std") == 0
    skew = F.when(flat | (F.col("count") < 3), 0.0).otherwise(F.col("_skew"))
    kurt = F.when(flat | (F.col("count") < 4), 0.0).otherwise(F.col("_kurt"))
    return one.withColumn("skewness", skew).withColumn("kurtosis", kurt).drop("_skew", "_kurt")


def quantiles(long: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, named q<percent>."""
    return quantiles_of(long, keys, "value", {f"q{round(q * 100)}": q for q in shares})


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, corr) for all pairs over complete rows; Spearman by average ranks, ranked without a global sort of rows."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    if method == "spearman":
        whole = rows
        for c in columns:
            counts = whole.groupBy(c).agg(F.count("*").alias("_n"))
            rows = rows.join(running_total(counts, c, "_n", f"_r_{c}").select(c, (F.col(f"_r_{c}") - (F.col("_n") - 1) / 2).alias(f"_r_{c}")), c)
        rows = rows.select(*[F.col(f"_r_{c}").alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], one.columns, "_pair", "corr")
    return long.select(F.split_part("_pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("_pair", F.lit("|"), F.lit(2)).alias("b"), "corr")


def running_total(df: DataFrame, order: str, weight: str, name: str) -> DataFrame:
    """Inclusive running sum of `weight` by `order` in two steps: buckets of about equally many rows, then rows inside a bucket."""
    return running_sum(df, order, weight, name)


def column_summary(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Range, share outside mean +- k sample deviations, different values, and share missing, per column."""
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    stats = whole.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count_distinct("value").alias("n_unique"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    out = whole.join(F.broadcast(stats), "column").groupBy("column").agg(F.avg((F.abs(F.col("value") - F.col("_m")) > k * F.col("_s")).cast("double")).alias("outliers"))
    return stats.join(out, "column").drop("_m", "_s")


def top_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n most frequent values of each column, ties by value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("place") <= n)


def window_statistics(windows: DataFrame, keys: list[str], column: str) -> DataFrame:
    return windows.groupBy(*keys).agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), F.stddev_samp(column).alias("std"), F.percentile(column, F.lit(0.5)).alias("median"))


def describe_labels(df: DataFrame, categories: list[str], numbers: list[str], ts: str) -> DataFrame:
    """(column_name, kind, item, n, low, high): a row per value of each category with its count; per number its range and known values; for the time its range and,
    as item, the most common step in seconds. Lists of values are rows, so none is bounded by one task's memory."""
    none = F.lit(None).cast("string")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in categories]).unpivot([], categories, "column_name", "item").where("item is not null")
    parts = [long.groupBy("column_name", "item").agg(F.count("*").alias("n")).select("column_name", F.lit("category").alias("kind"), "item", "n", none.alias("low"), none.alias("high"))]
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column_name", "v").groupBy("column_name").agg(F.count("v").alias("n"), F.min("v").cast("string").alias("low"), F.max("v").cast("string").alias("high"))
    parts.append(wide.select("column_name", F.lit("number").alias("kind"), none.alias("item"), "n", "low", "high"))
    step = mode_of(gaps(df, [], ts), [], "gap", "item")
    span = df.agg(F.count(ts).alias("n"), F.min(ts).cast("string").alias("low"), F.max(ts).cast("string").alias("high"))
    parts.append(span.join(F.broadcast(step)).select(F.lit(ts).alias("column_name"), F.lit("time").alias("kind"), F.col("item").cast("string").alias("item"), "n", "low", "high"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def populated(df: DataFrame, label: str, n: int, unique: list[str]) -> DataFrame:
    """Rows of the n most populated labels, one per `unique`."""
    top = df.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(n)
    return df.join(F.broadcast(top), label, "left_semi").dropDuplicates(unique)


def best_models(results: DataFrame, metrics: list[str], model: str = "model") -> DataFrame:
    """The model with the smallest value of each metric."""
    return results.unpivot([model], metrics, "metric", "value").groupBy("metric").agg(F.min(F.struct("value", model)).alias("_m")).select("metric", F.col(f"_m.{model}").alias(model), F.col("_m.value").alias("value"))


def weighted(groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the count-weighted mean and the maximum of group means."""
    return groups.groupBy(*keys).agg((F.sum(F.col(value) * F.col("count")) / F.sum("count")).alias("weighted_mean"), F.max(value).alias("top"))


def impact(features: Column, weights: dict[str, float], default: float) -> Column:
    """Sum of counts by level times a fixed weight."""
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v)])
    terms = F.transform(F.map_entries(features), lambda e: e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(default)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def clipped_weighted(columns: dict[str, float], low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), reduce(lambda a, b: a + b, (F.col(c) * w for c, w in columns.items()))))


def multivariate_score(scores: DataFrame, keys: list[str], measure: str, value: str, of_max: float, of_mean: float, padding: Column | None = None) -> DataFrame:
    """(keys, score): the mean over measures of of_max * greatest + of_mean * mean of a measure's scores, each cut to 0 .. 1. Rows that `padding` marks, and null scores, are left out."""
    rows = scores.where(F.col(value).isNotNull())
    rows = rows if padding is None else rows.where(~F.coalesce(padding, F.lit(False)))
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value)))
    each = rows.groupBy(*keys, measure).agg((F.max(cut) * of_max + F.avg(cut) * of_mean).alias("_s"))
    return each.groupBy(*keys).agg(F.avg("_s").alias("score"))


def dataset_descriptors(rows: DataFrame, dataset: str, series: list[str], results: DataFrame, model: str, at: list[str], error: str) -> DataFrame:
    """Per dataset its points, least, mean and greatest length of a series and number of series, a row for each model with its latest error; datasets without results keep one row.

    `results` may have a model many times: the last row in the order of `at` counts."""
    sizes = rows.groupBy(dataset, *series).agg(F.count("*").alias("_n"))
    each = sizes.groupBy(dataset).agg(F.sum("_n").alias("points"), F.min("_n").alias("low"), F.avg("_n").alias("mean"), F.max("_n").alias("high"), F.count("*").alias("series"))
    latest = results.groupBy(dataset, model).agg(F.max_by(error, F.struct(*at)).alias(error))
    return by_keys(each, latest, [dataset], "left")


def combine_scores(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, maximum and median over groups, each also without zeros."""
    some = F.when(F.col(value) != 0, F.col(value))
    out = scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.avg(some).alias("mean_nonzero"), F.count("*").alias("groups"))
    return with_quantiles(with_quantiles(out, scores, keys, value, {"median": 0.5}), scores, keys, some, {"median_nonzero": 0.5})


def regressions(base: DataFrame, new: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Percent change of each metric against a base table, flagged above a threshold; a base of 0 counts as 1e-10."""
    b = base.select(*keys, F.col(value).alias("base"))
    change = (F.col(value) - F.col("base")) / F.when(F.col("base") == 0, 1e-10).otherwise(F.col("base")) * 100
    return new.join(b, keys).withColumn("change", change).withColumn("flag", F.abs("change") > threshold * 100)

"""Regular calendars: spines, resampling up and down, rounding and padding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import by_keys
from .scans import edges_of, positioned
from .windows import interpolate

LEVELS = ["hour", "day", "week", "month", "quarter", "year"]
NTZ = "timestamp_ntz"


def truncated(unit: str, ts: str | Column) -> Column:
    return F.date_trunc(unit, ts).cast(NTZ)


def spine(df: DataFrame, keys: list[str], ts: str, step: str) -> DataFrame:
    """Every step from the first to the last timestamp of each series."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias(ts))


def regrid(df: DataFrame, keys: list[str], ts: str, value: str, unit: str) -> DataFrame:
    """Mean per calendar slot; slots without rows are null."""
    slots = df.groupBy(*keys, truncated(unit, ts).alias(ts)).agg(F.avg(value).alias(value))
    return spine(slots, keys, ts, f"interval 1 {unit}").join(slots, [*keys, ts], "left")


def period_start(level: str, ts: str | Column) -> Column:
    """The label of a period: its start, for quarters the first day after it."""
    start = truncated(level, ts)
    return (start + F.expr("interval 3 months")).cast(NTZ) if level == "quarter" else start


def downsample(df: DataFrame, keys: list[str], ts: str, value: str, level: str) -> DataFrame:
    return df.groupBy(*keys, period_start(level, ts).alias(ts)).agg(F.avg(value).alias(value))


#: How often a row of a level repeats one level below (a month once for every seven days or part of them), and the step.
REPEATS = {"year": ("quarter", 4, "interval 3 months"), "quarter": ("month", 3, "interval 1 month"), "month": ("week", None, "interval 7 days"), "week": ("day", 7, "interval 1 day"), "day": ("hour", 24, "interval 1 hour")}


def upsample(df: DataFrame, ts: str, level: str) -> DataFrame:
    """Each row repeated over the steps of the next finer level."""
    _, n, step = REPEATS[level]
    last = F.lit(n - 1) if n else F.when(F.dayofmonth(F.last_day(ts)) > 28, 4).otherwise(3)
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0), last))).withColumn(ts, (F.col(ts) + F.col("_k") * F.expr(step)).cast(NTZ)).drop("_k")


def resample_to(df: DataFrame, keys: list[str], ts: str, value: str, have: str, want: str) -> DataFrame:
    """From one level to another, one level at a time."""
    at = LEVELS.index(have)
    while LEVELS[at] != want:
        if at < LEVELS.index(want):
            at += 1
            df = downsample(df, keys, ts, value, LEVELS[at])
        else:
            df = upsample(df, ts, LEVELS[at])
            at -= 1
    return df


def all_levels(df: DataFrame, keys: list[str], ts: str, value: str, have: str, coarsest: str = "year", finest: str | None = None) -> DataFrame:
    """(level, keys, ts, value): the series at its own level and, one level after the other, at all coarser ones up to `coarsest` and finer ones down to `finest`."""
    at, out = LEVELS.index(have), [df.select(F.lit(have).alias("level"), *keys, ts, value)]
    for step, end in ((1, LEVELS.index(coarsest)), (-1, LEVELS.index(finest or have))):
        now, level = df, at
        while level != end:
            level += step
            now = resample_to(now, keys, ts, value, LEVELS[level - step], LEVELS[level])
            out.append(now.select(F.lit(LEVELS[level]).alias("level"), *keys, ts, value))
    return reduce(DataFrame.unionByName, out)


def longest(df: DataFrame, level: str, keys: list[str], n: int) -> DataFrame:
    """The n series with most rows of each level, ties by key."""
    counts = df.groupBy(level, *keys).agg(F.count("*").alias("_n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(level).orderBy(F.desc("_n"), *keys))).where(F.col("_r") <= n)  # Spark keeps n rows a level before the shuffle
    return df.join(best.select(level, *keys), [level, *keys], "left_semi")


def rounded(unit: str, ts: str) -> Column:
    """To the nearest slot: years from July up, months from the 16th up, hours from half past up; quarters down."""
    c = F.col(ts)
    if unit == "year":
        return truncated("year", c + F.expr("interval 6 months"))
    if unit == "month":
        return F.when(F.dayofmonth(c) >= 16, truncated("month", F.add_months(c, 1))).otherwise(truncated("month", c))
    if unit == "quarter":
        return truncated("quarter", c)
    half = {"hour": "interval 30 minutes", "day": "interval 12 hours", "minute": "interval 30 seconds"}[unit]
    return truncated(unit, c + F.expr(half))


def bucket(ts: str, seconds: int) -> Column:
    since = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast(NTZ), F.col(ts))
    start = F.floor(since / seconds) * seconds
    return F.timestamp_add("SECOND", start, F.lit("1970-01-01").cast(NTZ))


def resample(df: DataFrame, keys: list[str], ts: str, seconds: int, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Any interval with named aggregates: out -> (column, mean | sum | median | min | max | first | last)."""
    how = {"mean": F.avg, "sum": F.sum, "median": F.median, "min": F.min, "max": F.max, "first": lambda c: F.min_by(c, ts), "last": lambda c: F.max_by(c, ts)}
    return df.groupBy(*keys, bucket(ts, seconds).alias("slot")).agg(*[how[f](c).alias(name) for name, (c, f) in aggregates.items()])


def resample_filled(df: DataFrame, keys: list[str], ts: str, seconds: int, numbers: dict[str, tuple[str, str]], texts: dict[str, tuple[str, str]]) -> DataFrame:
    """As `resample`, with a row for every slot from a series' first to its last: numbers of empty slots are interpolated, texts (out -> (column, first | last)) are null there; a text that is not named is dropped."""
    slots = resample(df, keys, ts, seconds, numbers | texts)
    ends = slots.groupBy(*keys).agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
    every = ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {seconds} seconds"))).alias("slot"))
    edges = edges_of(every, "slot") if numbers else None  # of the bare slots: the table beside them is not worked out for it
    out = by_keys(every, slots, [*keys, "slot"], "left")
    for name in numbers:
        out = interpolate(out.withColumn(name, F.col(name).cast("double")), keys, ["slot"], name, edges=edges).drop(name).withColumnRenamed(f"{name}_filled", name)
    return out


def every_kth(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    return positioned(df, keys, order, "_n").where(F.col("_n") % k == 0).drop("_n")


def padded(df: DataFrame, keys: list[str], ts: str, value: str, size: int) -> DataFrame:
    """Short series get null rows at the front, stepping back by the median gap in seconds."""
    short = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(ts).alias("_lo")).where((F.col("_n") < size) & (F.col("_n") > 1))
    rows = by_keys(df.select(*keys, ts), short.select(*keys), keys)  # series of fewer than `size` rows
    w = Window.partitionBy(*keys).orderBy(ts)
    gaps = rows.withColumn("_gap", F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)))
    stats = by_keys(short, gaps.groupBy(*keys).agg(F.floor(F.percentile("_gap", F.lit(0.5))).alias("_step")), keys)
    front = stats.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(size) - F.col("_n")))).select(*keys, F.timestamp_add("SECOND", -F.col("_k") * F.col("_step"), F.col("_lo")).alias(ts), F.lit(None).cast("double").alias(value))
    return df.select(*keys, ts, value).unionByName(front)

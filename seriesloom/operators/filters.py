"""Filters on rows, on series of a catalog, and on windows.

Window filters decide per window_idx in one aggregate and keep rows by a
semi join, so any number of conditions costs one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import quantiles_of
from .scans import positioned

FREQUENCIES = ["yearly", "quarterly", "monthly", "weekly", "daily", "hourly"]  # fixed order, coarse to fine


def group_filter(df: DataFrame, filters: list[dict[str, list]]) -> DataFrame:
    """All dicts must hold; a dict holds if any of its columns has any of its values; one without a known column never holds."""

    def one(accepted: dict[str, list]) -> Column:
        known = [F.col(c).isin(widened(df, c, values)) for c, values in accepted.items() if c in df.columns]
        return reduce(lambda a, b: a | b, known, F.lit(False))

    return df.where(reduce(lambda a, b: a & b, map(one, filters), F.lit(True)))


def widened(df: DataFrame, column: str, values: list) -> list:
    """The literals in the column's own type; those that do not fit are dropped."""
    kind, out = dict(df.dtypes)[column], []
    for v in values:
        try:
            if kind == "string":
                out.append(str(v))
            elif kind in ("int", "bigint", "smallint", "tinyint"):
                if float(v) == int(float(v)):
                    out.append(int(float(v)))
            elif kind in ("double", "float"):
                out.append(float(v))
            else:
                out.append(v)
        except (TypeError, ValueError):
            continue
    return out


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def metadata_condition(name: str, value: object) -> Column:
    """A predicate on a catalog row by name: size_leq, length_geq, num_columns_leq, frequency_geq, keyword, columns_<field>, or a field (substring, equality or a list)."""
    rank = lambda f: F.array_position(F.array(*map(F.lit, FREQUENCIES)), F.lower(f))
    field, _, how = name.rpartition("_")
    if how in ("leq", "geq", "eq") and field == "frequency":
        a, b = rank(F.col("frequency")), rank(F.lit(value))
        return {"leq": a <= b, "geq": a >= b, "eq": a == b}[how]
    if how in ("leq", "geq"):
        return F.col(field) <= value if how == "leq" else F.col(field) >= value
    if name == "keyword":
        return F.exists("columns", lambda c: F.lower(c["title"]).contains(str(value).lower()) | F.lower(c["description"]).contains(str(value).lower()))
    if name.startswith("columns_"):
        return F.exists("columns", lambda c: F.lower(c[name[8:]].cast("string")).contains(str(value).lower()))
    if isinstance(value, list):
        return F.col(name).isin(value)
    return F.lower(name).contains(value.lower()) if isinstance(value, str) else F.col(name) == value


def metadata_filter(catalog: DataFrame, **conditions) -> DataFrame:
    return catalog.where(reduce(lambda a, b: a & b, (metadata_condition(k, v) for k, v in conditions.items()), F.lit(True)))


def time_slice(df: DataFrame, ts: str, low, high) -> DataFrame:
    return df.where(F.col(ts).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))


def series_by_length(df: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n").between(low, high)).drop("_n")
    return df.join(counts, keys, "left_semi")


def keep_windows(df: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """Rows of windows for which an aggregate condition is true."""
    good = df.groupBy(*keys).agg(condition.alias("_ok")).where("_ok").drop("_ok")
    return df.join(good, keys, "left_semi")


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a & b, ((F.min(c) >= lo) & (F.max(c) <= hi) for c, (lo, hi) in ranges.items()))


def in_options(options: dict[str, list]) -> Column:
    return reduce(lambda a, b: a & b, (F.bool_and(F.coalesce(F.col(c).isin(v), F.lit(False))) for c, v in options.items()))


def labelled(columns: list[str], tuples: list[str]) -> Column:
    return F.bool_or(F.concat_ws("-", *columns).isin(tuples))


def inside(ts: str, low, high, size: int) -> Column:
    return F.count_if(F.col(ts).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))) == size


def in_slot(ts: str, **slot: int) -> Column:
    """Touches a calendar slot: hour (with the hour after it), minute, day_of_week (1 = Monday), day_of_month, month."""
    c = F.col(ts)
    parts = {"minute": lambda v: F.minute(c) == v, "hour": lambda v: F.hour(c).between(v, v + 1), "day_of_week": lambda v: F.weekday(c) + 1 == v, "day_of_month": lambda v: F.dayofmonth(c) == v, "month": lambda v: F.month(c) == v}
    return F.bool_or(reduce(lambda a, b: a & b, (parts[k](v) for k, v in slot.items())))


STATISTICS = {"mean": F.avg, "min": F.min, "max": F.max, "sd": F.stddev_samp, "median": lambda c: F.percentile(c, F.lit(0.5))}
COMPARE = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "geq": lambda a, b: a >= b, "leq": lambda a, b: a <= b, "eq": lambda a, b: a == b}


def by_statistic(column: str, statistic: str, how: str, value: float) -> Column:
    return COMPARE[how](STATISTICS[statistic](column), F.lit(value))


def by_percentile(df: DataFrame, keys: list[str], column: str, how: str, share: float, zeros: bool = True) -> DataFrame:
    """Windows whose median compares with a percentile of all window medians."""
    medians = df.groupBy(*keys).agg(F.percentile(column, F.lit(0.5)).alias("_m"))
    limit = quantiles_of(medians if zeros else medians.where("_m <> 0"), [], "_m", {"_p": share})
    good = medians.join(F.broadcast(limit)).where(COMPARE[how](F.col("_m"), F.col("_p"))).select(*keys)  # one row
    return df.join(good, keys, "left_semi")


def by_category(df: DataFrame, keys: list[str], column: str, include: list, exclude: list) -> DataFrame:
    """Windows with an included value and none that is excluded; an include list that matches nothing is ignored."""
    flags = df.groupBy(*keys).agg(F.bool_or(F.col(column).isin(include)).alias("_in"), F.bool_or(F.col(column).isin(exclude)).alias("_out"))
    anything = flags.agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("_any"))
    good = flags.join(F.broadcast(anything)).where("not coalesce(_out, false) and (coalesce(_in, false) or not _any)").select(*keys)  # one row
    return df.join(good, keys, "left_semi")


def renumbered(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Window ids 0 .. N-1, in the order of a hash of their keys."""
    ids = windows.select(*keys).distinct().withColumn("_h", F.xxhash64(*keys))
    return windows.join(positioned(ids, [], ["_h", *keys], "new_idx").drop("_h"), keys)


def substring_search(df: DataFrame, column: str, term: str, n: int) -> DataFrame:
    return df.where(F.lower(column).contains(term.lower())).orderBy(column).limit(n)


def regex_search(df: DataFrame, column: str, pattern: str, order: str, n: int) -> DataFrame:
    return df.where(F.col(column).rlike(pattern)).orderBy(order).limit(n)


def cutoff_use(df: DataFrame, keys: list[str], ts: str, cutoff) -> DataFrame:
    """Per series: usable for training (starts before the cutoff) and for testing (ends after it)."""
    cut = F.lit(cutoff).cast("timestamp_ntz")
    return df.groupBy(*keys).agg((F.min(ts) < cut).alias("train"), (F.max(ts) > cut).alias("test"))


def varying(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of series whose variance is not zero."""
    good = df.groupBy(*keys).agg(F.var_pop(column).alias("_v")).where("_v > 0").drop("_v")
    return df.join(good, keys, "left_semi")

"""Calendar features, frequency detection, zones and forecast timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import mode_of
from .scans import chunked, positioned

NTZ = "timestamp_ntz"
EPOCH = "1970-01-01"


def scaled_parts(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Year scaled by the series' range to -0.5 .. 0.5 (0 for one year), other parts by fixed ranges."""
    c = F.col(ts)
    years = df.groupBy(*keys).agg(F.min(F.year(ts)).alias("_lo"), F.max(F.year(ts)).alias("_hi"))
    out = df.join(years, keys)
    year = F.coalesce(F.try_divide(F.year(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")) - 0.5, F.lit(0.0))
    return out.withColumns({"time_Y": year, "time_M": (F.month(c) - 6) / 12, "time_D": (F.dayofmonth(c) - 15.5) / 31, "time_H": (F.hour(c) - 12) / 24, "time_T": F.minute(c) / 60, "time_S": F.floor(F.second(c)) / 60}).drop("_lo", "_hi")


def unscaled_parts(year_low: Column, year_high: Column) -> Column:
    """The timestamp that scaled_parts came from."""
    year = F.round((F.col("time_Y") + 0.5) * (year_high - year_low)) + year_low
    year = F.when(year_high == year_low, year_low).otherwise(year)
    part = lambda e: F.round(e).cast("int")
    return F.make_timestamp_ntz(year.cast("int"), part(F.col("time_M") * 12 + 6), part(F.col("time_D") * 31 + 15.5), part(F.col("time_H") * 24 + 12), part(F.col("time_T") * 60), F.round(F.col("time_S") * 60).cast("decimal(8, 6)"))


#: The years and the hours of zone offsets that are scaled to 0 .. 1.
YEARS, OFFSETS = (1970, 2030), (-12, 14)


def calendar_vector(df: DataFrame, ts: str, holidays: DataFrame, offset: float | Column = 0.0) -> DataFrame:
    """Parts scaled to 0 .. 1 (years and zone offsets outside their ranges pass these), and a holiday flag. `offset`: hours of the zone against UTC, one value or a column. A null time has null parts and no holiday."""
    c = F.col(ts)
    hours = offset if isinstance(offset, Column) else F.lit(float(offset))
    parts = {
        "quarter": (F.quarter(c) - 1) / 3, "month": (F.month(c) - 1) / 11, "week": (F.weekofyear(c) - 1) / 52, "day": (F.dayofmonth(c) - 1) / 30, "hour": F.hour(c) / 23, "minute": F.minute(c) / 59,
        "year": (F.year(c) - YEARS[0]) / (YEARS[1] - YEARS[0]), "weekday": F.weekday(c) / 6, "second": F.floor(F.second(c)) / 59, "zone": F.when(c.isNotNull(), (hours - OFFSETS[0]) / (OFFSETS[1] - OFFSETS[0])),
    }
    marked = holidays.select(F.col("holiday").alias("_h")).distinct()
    return df.withColumns(parts).join(marked, F.to_date(c) == F.col("_h"), "left").withColumn("is_holiday", F.col("_h").isNotNull()).drop("_h")


def cyclic_features(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Sine and cosine of six calendar parts, the year, and a running index: 14 columns."""
    c = F.col(ts)
    parts = {"hour": (F.hour(c), 24), "weekday": (F.weekday(c), 7), "day": (F.dayofmonth(c), 31), "yearday": (F.dayofyear(c), 366), "week": (F.weekofyear(c), 53), "month": (F.month(c), 12)}
    angle = {k: p * (2 * math.pi / n) for k, (p, n) in parts.items()}
    out = df.withColumns({f"{k}_sin": F.sin(a) for k, a in angle.items()} | {f"{k}_cos": F.cos(a) for k, a in angle.items()})
    return positioned(out.withColumn("year", F.year(c)), keys, [ts], "index")


def gaps(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Seconds between neighbouring distinct timestamps."""
    c = chunked(df.select(*keys, ts).distinct(), keys, [ts], before=1)
    return c.own(c.rows.withColumn("gap", F.timestamp_diff("SECOND", F.lag(ts).over(c.window), F.col(ts)))).where("gap is not null")


#: Upper ends of gap lengths in seconds, by unit; fixed values.
UNITS = [("second", 59), ("minute", 3599), ("hour", 86399), ("day", 6 * 86400), ("week", 27 * 86400), ("month", 88 * 86400), ("quarter", 360 * 86400)]


def frequency(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The most common gap of each series (the smallest of ties) and its unit."""
    modal = mode_of(gaps(df, keys, ts), keys, "gap", "gap")
    unit = F.lit("year")
    for name, most in reversed(UNITS):
        unit = F.when(F.col("gap") <= most, name).otherwise(unit)
    return modal.withColumn("unit", unit)


def row_step(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Steps that follow the calendar: share of the modal day of month and of month ends, with the modal gap."""
    days = df.select(*keys, ts).distinct()
    modal = days.groupBy(*keys).agg(F.mode(F.dayofmonth(ts), True).alias("_d"))
    shares = days.join(modal, keys).groupBy(*keys).agg(F.avg((F.dayofmonth(ts) == F.col("_d")).cast("double")).alias("same_day"), F.avg((F.to_date(ts) == F.last_day(ts)).cast("double")).alias("month_end"))
    out = shares.join(frequency(df, keys, ts), keys)
    monthly = (F.col("same_day") > 0.8) | (F.col("month_end") > 0.8)
    return out.withColumn("step", F.when(monthly & (F.col("gap") >= 27 * 86400), F.concat(F.round(F.col("gap") / (30.4 * 86400)).cast("int"), F.lit(" month"))).otherwise(F.concat("gap", F.lit(" second"))))


def interval_summary(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    span = df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    steps = gaps(df, keys, ts).groupBy(*keys).agg(F.min("gap").alias("smallest"), F.max("gap").alias("largest"), F.mode("gap", True).alias("modal"))
    return span.join(steps, keys, "left")


def timestamp_range(df: DataFrame, ts: str) -> DataFrame:
    """First and last timestamp; a column of nulls is an error."""
    one = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    return one.select(F.when(F.col("first").isNull(), F.raise_error(F.lit(f"{ts} has no value")).cast(NTZ)).otherwise(F.col("first")).alias("first"), "last")


def future_timestamps(last: DataFrame, ts: str, n: int, step: str) -> DataFrame:
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("future", (F.col(ts) + F.col("step") * F.expr(step)).cast(NTZ))


def forecast_frame(df: DataFrame, keys: list[str], ts: str, low, cutoff, high) -> DataFrame:
    """Rows from the first at or after `low`: history to the last row at or before `cutoff`, then the truth to `high`."""
    at = lambda v: F.lit(v).cast(NTZ)
    inside = df.where(F.col(ts).between(at(low), at(high)))
    return inside.withColumn("part", F.when(F.col(ts) <= at(cutoff), "history").otherwise("truth"))


def coded_start(code: str, freq: str) -> Column:
    """Seconds since 1970 of YYMM (monthly), YYQ (quarterly) or YYYY (yearly) codes; two-digit years from 30 up are of the last century."""
    c, year2 = F.col(code), F.substring(code, 1, 2).cast("int")
    year = F.when(F.col(freq) == "yearly", F.substring(code, 1, 4).cast("int")).otherwise(F.when(year2 >= 30, year2 + 1900).otherwise(year2 + 2000))
    month = F.when(F.col(freq) == "monthly", F.substring(c, 3, 2).cast("int")).when(F.col(freq) == "quarterly", F.substring(c, 3, 1).cast("int") * 3 - 2).otherwise(1)
    return F.date_diff(F.make_date(year, month, F.lit(1)), F.lit(EPOCH).cast("date")) * 86400


def date_chunks(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """A date range as pieces of at most n days."""
    piece = df.withColumn("chunk_start", F.explode(F.sequence(start, end, F.expr(f"interval {days} days"))))
    return piece.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(end)))


def decimal_hours(text: str) -> Column:
    return F.split_part(F.col(text), F.lit(":"), F.lit(1)).cast("double") + F.split_part(F.col(text), F.lit(":"), F.lit(2)).cast("double") / 60

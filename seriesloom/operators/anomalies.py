"""Anomalies per KPI and group, and concurrent ones across KPIs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import decomposition
from .order_statistics import by_keys, quantiles_of
from .windows import pattern_score, volatility


def window_sizes(frequency: str) -> dict[str, int]:
    """Rows per day and week from a frequency such as 15min, H, D, W or M."""
    n, unit = re.fullmatch(r"(\d*)(T|min|H|D|W|M)", frequency).groups()
    per_day = {"T": 1440, "min": 1440, "H": 24, "D": 1, "W": 1, "M": 1}[unit] // int(n or 1) or 1
    return {"day": per_day, "week": per_day * 7}


def usable(df: DataFrame, kpis: list[str], keys: list[str], ts: str, least: int) -> DataFrame:
    """Long rows (kpi, keys, ts, value) of series that vary and have enough rows; one row per timestamp, no nulls."""
    long = df.select(*keys, ts, *[F.col(k).cast("double").alias(k) for k in kpis]).unpivot([*keys, ts], kpis, "kpi", "value").dropna(subset=["value"]).dropDuplicates(["kpi", *keys, ts])
    good = long.groupBy("kpi", *keys).agg(F.count("*").alias("_n"), F.min("value").alias("_a"), F.max("value").alias("_b")).where((F.col("_n") >= least) & (F.col("_a") < F.col("_b")))
    return long.join(good.select("kpi", *keys), ["kpi", *keys], "left_semi")


def scattered(long: DataFrame, keys: list[str], ts: str, size: int, baseline: int, threshold: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose deviations have grown: a volatility score above a threshold; rows of the same time are in the order of `ties`."""
    return volatility(long, keys, [ts, *ties], "value", size, baseline).where(F.col("score") > threshold)


def out_of_pattern(long: DataFrame, keys: list[str], ts: str, period: int, threshold: float, hours: bool = True) -> DataFrame:
    """Rows far from what earlier periods, their hour and their weekday are used to: a pattern score above a threshold."""
    return pattern_score(long, keys, ts, "value", period, hours=hours).where(F.col("pattern_score") > threshold)


def peaks(long: DataFrame, keys: list[str], ts: str, period: int, band: float) -> DataFrame:
    """Values outside trend + season -+ band deviations of the rest; the score is the rest over a quarter of the band."""
    parts = decomposition(long, keys, [ts], "value", period)
    parts = parts.withColumn("_spread", F.stddev_samp("rest").over(Window.partitionBy(*keys)))
    width = 2 * band * F.col("_spread")
    return parts.withColumn("score", F.abs("rest") / (width / 4)).withColumn("predicted", F.col("trend") + F.col("seasonal")).where(F.abs("rest") > band * F.col("_spread")).drop("_spread")


def strongest(found: DataFrame, keys: list[str], score: str, least: float, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "ts")
    return found.where(F.col(score) >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def concurrent(anomalies: DataFrame, ts: str, kpi: str, score: str, seconds: int, least: int) -> DataFrame:
    """Anchors (t, k, v) with anomalies of at least `least` KPIs within `seconds` after them, their sum counted for every copy of the anchor.

    Rows become one a second first. Time is cut into cells one second longer than the span, so a second sees its own cell from itself on, a running state from behind,
    and the next cell up to the span's end, a running state for which each second stands in the cell before as well. So no pairs are made, however dense the anomalies are."""
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    second = ((since - F.pmod(since, F.lit(1_000_000))) / 1_000_000).cast("long")
    rows = anomalies.select(F.col(ts).alias("t"), second.alias("s"), F.col(kpi).alias("k"), F.col(score).alias("v")).where("s is not null")
    anchors = rows.groupBy("t", "s", "k", "v").agg(F.count("*").alias("_m"))
    each, length = rows.groupBy("s", "k").agg(F.sum("v").alias("v")), seconds + 1
    now = each.select("s", F.col("s").alias("_at"), "k", F.col("k").alias("_k"), F.col("v").alias("_v"))
    later = each.select((F.col("s") - length).alias("_at"), F.col("k").alias("_k2"), F.col("v").alias("_v2"))
    both = now.unionByName(later, allowMissingColumns=True).withColumn("_cell", F.expr(f"(_at - pmod(_at, {length}L)) div {length}L"))
    part = Window.partitionBy("_cell")  # at most two rows a second of the span and KPI
    own, ahead = part.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0), part.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({"_x": F.sum("_v").over(own), "_ks": F.collect_set("_k").over(own), "_x2": F.sum("_v2").over(ahead), "_ks2": F.collect_set("_k2").over(ahead)}).where("s is not null")
    seen = seen.select("s", "k", F.size(F.array_union("_ks", "_ks2")).cast("long").alias("kpis"), F.coalesce(F.col("_x") + F.col("_x2"), "_x", "_x2").alias("_sum")).where(F.col("kpis") >= least)
    return by_keys(anchors, seen, ["s", "k"]).select("t", "k", "v", "kpis", (F.col("_sum") * F.col("_m")).alias("total"))


def timestamp_union(found: DataFrame, ts: str, channel: str, score: str) -> DataFrame:
    """(ts, channels, worst): the timestamps at which any channel is anomalous, with how many are and the largest score."""
    return found.groupBy(ts).agg(F.count_distinct(channel).alias("channels"), F.max(score).alias("worst"))


def modified_z(df: DataFrame, keys: list[str], residual: str, threshold: float) -> DataFrame:
    """0.6745 (r - median) / MAD above a threshold; without spread all values are anomalous unless the median is 0."""
    d = by_keys(df, quantiles_of(df, keys, residual, {"_med": 0.5}), keys)
    mad = quantiles_of(d, keys, F.abs(F.col(residual) - F.col("_med")), {"_mad": 0.5})
    z = F.try_divide(0.6745 * (F.col(residual) - F.col("_med")), F.col("_mad"))
    flag = F.when(F.col("_mad") == 0, F.col("_med") != 0).otherwise(F.abs(z) > threshold)
    return by_keys(d, mad, keys).withColumn("z", z).withColumn("anomalous", flag).drop("_med", "_mad")

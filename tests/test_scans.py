"""Ordered scans in chunks against pandas and scipy-like loops: nulls, ties of keys, short and long series, one hot series."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import order_statistics, scans, windows

KEYS, ORDER = ["k"], ["t"]


@pytest.fixture(scope="module")
def frame():
    r = random.Random(5)
    rows = []
    for key, n in (("hot", 700), ("b", 40), ("one", 1), ("gone", 12), (None, 30)):
        at = sorted(r.sample(range(10 * n), n))
        rows += [(key, t, None if key == "gone" or r.random() < 0.3 else round(r.gauss(50, 20), 3)) for t in at]
    r.shuffle(rows)
    return pd.DataFrame(rows, columns=["k", "t", "x"]).sort_values(["k", "t"], na_position="first").reset_index(drop=True)


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [(k, int(t), None if x != x else float(x)) for k, t, x in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, t long, x double").repartition(4)


def by_series(frame, function):
    """The function of each series' values, in the order of `frame`."""
    return pd.concat([function(g) for _, g in frame.groupby("k", sort=False, dropna=False)]).reindex(frame.index)


def same(found, column, wanted):
    got = found.toPandas().sort_values(["k", "t"], na_position="first")[column].to_numpy(float)
    np.testing.assert_allclose(got, np.asarray(wanted, float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 14])
def test_positions(df, frame, chunk):
    out = scans.positioned(df, KEYS, ORDER, "pos", "n", chunk)
    same(out, "pos", by_series(frame, lambda g: pd.Series(range(len(g)), g.index)))
    same(out, "n", by_series(frame, lambda g: pd.Series(len(g), g.index)))


def test_buckets_are_even_whatever_the_values_are(spark):
    heavy = spark.range(20_000).select(F.pow(F.col("id") / 20_000, 4.0).alias("v"))
    like = spark.range(20_000).select(F.concat(F.lit("http://example.org/a/long/common/prefix/"), F.col("id").cast("string")).alias("v"))
    for table in (heavy, like):
        n, placed = scans.placed_in_buckets(table, "v", most=63)
        sizes = [r["count"] for r in placed.groupBy("_b").count().collect()]
        assert n == 20_000 and len(sizes) > 50 and max(sizes) <= 4 * 20_000 / 64
        ends = placed.groupBy("_b").agg(F.min("v").alias("a"), F.max("v").alias("z")).orderBy("_b").collect()
        assert all(x["z"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_no_task_holds_more_than_a_chunk_of_one_series(spark):
    one = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    c = scans.chunked(one, KEYS, ORDER, before=10, after=5, chunk=100)
    assert c.rows.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] == 115
    assert c.own().count() == 5000


@pytest.mark.parametrize("chunk", [16, 1 << 14])
def test_fills(df, frame, chunk):
    same(windows.filled_both_ways(df, KEYS, ORDER, {"f": "x"}, -1.0, chunk), "f", by_series(frame, lambda g: g["x"].ffill().bfill().fillna(-1.0)))
    line = by_series(frame, lambda g: g["x"].reset_index(drop=True).interpolate(limit_direction="both").fillna(0.0).set_axis(g.index))
    same(windows.interpolate(df, KEYS, ORDER, "x", chunk), "x_filled", line)


@pytest.mark.parametrize("chunk", [5, 16, 1 << 14])
@pytest.mark.parametrize("span", [3, 40])
def test_exponential_means_are_those_of_pandas(df, frame, span, chunk):
    out = windows.ema(df, KEYS, ORDER, "x", span, chunk=chunk)
    same(out, "x_ema", by_series(frame, lambda g: g["x"].ewm(span=span).mean()))
    got = out.toPandas().sort_values(["k", "t"], na_position="first")["x_ema_std"].to_numpy(float)
    np.testing.assert_allclose(got, by_series(frame, lambda g: g["x"].ewm(span=span).std()), rtol=1e-5, atol=1e-6, equal_nan=True)
    same(windows.ema(df, KEYS, ORDER, "x", span, adjust=False, chunk=chunk), "x_ema", by_series(frame, lambda g: g["x"].ewm(span=span, adjust=False).mean()))


@pytest.mark.parametrize("chunk", [16, 1 << 14])
def test_rolling_means(df, frame, chunk):
    same(windows.rolling_mean(df, KEYS, ORDER, "x", 5, chunk), "x_mean_5", by_series(frame, lambda g: g["x"].rolling(5, min_periods=1).mean()))
    lag = by_series(frame, lambda g: g["x"].shift(3).where(np.arange(len(g)) >= 3, 0.0))
    same(windows.lag_or_zero(df, KEYS, ORDER, "x", 3, chunk), "x_lag_3", lag)


@pytest.mark.parametrize("buckets", [3, 200])
def test_rolling_mean_in_time(spark, df, frame, buckets):
    timed = df.withColumn("at", F.timestamp_add("SECOND", F.col("t").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    out = windows.rolling_mean_in_time(timed, KEYS, "at", "x", 45, buckets)
    wanted = by_series(frame, lambda g: pd.Series(g["x"].to_numpy(), pd.to_datetime(g["t"], unit="s")).rolling("45s", min_periods=1).mean().set_axis(g.index))
    same(out, "x_mean", wanted)


def reflected(values, sigma):
    """A Gaussian filter by its definition, over the half-sample mirrored series."""
    reach, n = int(4 * sigma + 0.5), len(values)
    g = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    at = lambda i: min(i % (2 * n), 2 * n - 1 - i % (2 * n))
    return [sum(w * values[at(i + k)] for w, k in zip(g, range(-reach, reach + 1))) / sum(g) for i in range(n)]


@pytest.mark.parametrize("chunk", [16, 1 << 14])
@pytest.mark.parametrize("sigma", [1.0, 6.0])
def test_gaussian_smoothing_reflects(df, frame, sigma, chunk):
    def one(g):
        filled = g["x"].ffill().bfill()
        return pd.Series(reflected(filled.to_list(), sigma), g.index).where(g["x"].notna())

    same(windows.gaussian_smooth(df, KEYS, ORDER, "x", sigma, chunk), "x_smooth", by_series(frame, one))


@pytest.mark.parametrize("chunk", [40, 1 << 14])
def test_volatility_is_that_of_its_definition(spark, chunk):
    r = random.Random(2)
    values = [r.gauss(10, 1 + i % 50) for i in range(300)]
    y = pd.Series(values)
    parts = [y.rolling(6).std(), y.rolling(6).apply(lambda x: np.median(np.abs(x - np.median(x)))), y.ewm(span=6).std()]
    score = pd.DataFrame([(p - p.rolling(20).mean()) / p.rolling(20).mean() for p in parts]).T.mean(axis=1)
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t long, x double")
    out = windows.volatility(frame, KEYS, ORDER, "x", 6, 20, chunk)
    for name, wanted in zip(("roll_std", "roll_mad", "ewm_std", "score"), (*parts, score)):
        same(out, name, wanted)


def test_pattern_score_is_that_of_its_definition(spark):
    r = random.Random(4)
    at = pd.date_range("2024-01-01", periods=800, freq="h")
    y = pd.Series([50 + 10 * math.sin(i / 4) + r.gauss(0, 3) for i in range(800)])
    back = pd.DataFrame({i: y.shift(24 * i) for i in range(1, 5)})
    scores = pd.DataFrame({"slot": (y - back.mean(axis=1)).abs() / (back.std(axis=1) + 1e-6)})
    for name, part in (("hour", at.hour), ("weekday", at.dayofweek)):
        scores[name] = (y - y.groupby(part).transform("mean")).abs() / (y.groupby(part).transform("std") + 1e-6)
    frame = spark.createDataFrame([("a", i, t.to_pydatetime(), v) for i, (t, v) in enumerate(zip(at, y))], "k string, t long, at timestamp_ntz, x double")
    out = windows.pattern_score(frame, KEYS, "at", "x", 24, chunk=100)
    same(out, "pattern_score", scores.mean(axis=1))


def test_segments_and_lags_over_chunk_edges(df, frame):
    backwards = df.withColumn("w", (F.col("t") * 7) % 50)
    small, whole = (windows.segments(backwards, KEYS, ORDER, "w", 1, chunk).select("k", "t", "segment") for chunk in (9, 1 << 14))
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))


def test_ranks_of_texts_with_a_common_prefix(spark):
    words = [f"http://{i % 997:04d}" for i in range(3000)] + [None]
    out = order_statistics.dense_rank_of_text(spark.createDataFrame([(w,) for w in words], "w string"), "w", "rank").collect()
    assert {r["w"]: r["rank"] for r in out} == {w: i for i, w in enumerate(sorted(set(words) - {None}), 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t long, x double")
    for out in (windows.ema(none, KEYS, ORDER, "x", 3), windows.gaussian_smooth(none, KEYS, ORDER, "x", 1.0), windows.interpolate(none, KEYS, ORDER, "x"), windows.sliding_windows(none, KEYS, ORDER, 3, 1)):
        assert out.count() == 0

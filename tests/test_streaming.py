"""The streaming jobs on a real file stream, against the same logic on the whole table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriesloom.streaming import jobs

DATA = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    spark.read.parquet(DATA).repartitionByRange(4, "ts").write.parquet(path)
    return path


def test_usage_counts(spark, folder, tmp_path):
    out = jobs.run_to_table(jobs.usage_counts(jobs.event_stream(spark, folder, per_trigger=10)), "usage", "complete", str(tmp_path / "c"))
    whole = jobs.usage_counts(spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, out.drop("users").collect())) == sorted(map(tuple, whole.drop("users").collect()))


def test_repeats_go_within_the_watermark(spark, folder, tmp_path):
    stream = jobs.event_stream(spark, folder, per_trigger=10)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = jobs.run_to_table(jobs.without_repeats(twice, ["event_id"]), "once", "append", str(tmp_path / "c"))
    assert out.count() == spark.read.parquet(DATA).count()


def test_sessions_of_closed_windows(spark, folder, tmp_path):
    out = jobs.run_to_table(jobs.sessions(jobs.event_stream(spark, folder, per_trigger=10)), "sessions", "append", str(tmp_path / "c"))
    whole = jobs.sessions(spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp")))
    found = set(map(tuple, out.collect()))
    assert found and found <= set(map(tuple, whole.collect()))


def test_rolling_scores(spark, folder, tmp_path):
    e = spark.read.parquet(DATA)
    base = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    out = jobs.run_to_table(jobs.rolling_scores(jobs.event_stream(spark, folder, per_trigger=10), base, threshold=0.0), "rolling", "append", str(tmp_path / "c"))
    whole = jobs.rolling_scores(e.withColumn("ts", F.col("ts").cast("timestamp")), base, threshold=0.0)
    keys = {(r["start"], r["event_type"]) for r in whole.collect()}
    assert out.count() and {(r["start"], r["event_type"]) for r in out.collect()} <= keys

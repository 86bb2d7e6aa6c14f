"""Usage counts, deduplication, rolling scores, sessions and per-batch payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import merge_repeated
from ..operators.filters import group_filter
from ..sources.readers import from_column_json

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, ts: str = "ts", per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with a zoned timestamp for watermarks."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def usage_counts(stream: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and distinct status values per type and window; the payload is parsed and the user hashed."""
    rows = stream.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("user", F.sha2(F.col("user_id").cast("string"), 256))
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.approx_count_distinct("user").alias("users"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "k", "users")


def endpoint_health(stream: DataFrame, endpoint: Column, status: Column, latency: Column, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Requests, share of failed ones (an HTTP status of 400 or more), mean and greatest latency, per endpoint and window. A row without a status counts as a request, but not in the share."""
    rows = stream.withColumns({"endpoint": endpoint, "_failed": (status >= 400).cast("double"), "_latency": latency.cast("double")})
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", window), "endpoint")
    found = sums.agg(F.count("*").alias("n"), F.avg("_failed").alias("error_share"), F.avg("_latency").alias("mean_latency"), F.max("_latency").alias("worst_latency"))
    return found.select(F.col("window.start").alias("start"), "endpoint", "n", "error_share", "mean_latency", "worst_latency")


def without_repeats(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rolling_scores(stream: DataFrame, baseline: DataFrame, window: str = "6 hours", slide: str = "1 hour", late: str = "1 hour", threshold: float = 1.0) -> DataFrame:
    """Sliding means per type against a static baseline (event_type, mean, spread); scores over a threshold."""
    means = stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.avg("value").alias("mean_now"))
    score = F.abs(F.col("mean_now") - F.col("mean")) / (F.col("spread") + 1e-6)
    return means.join(baseline, "event_type").withColumn("score", score).where(F.col("score") > threshold).select(F.col("window.start").alias("start"), "event_type", "score")


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Activity of each user cut at gaps."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def payload_batch(batch: DataFrame, columns: list[str], filters: list[dict[str, list]], ts: str, keys: list[str], numeric: list[str]) -> DataFrame:
    """One micro-batch of posted payloads: parse, filter by labels, merge repeated timestamps."""
    rows = from_column_json(batch, "payload", [], columns)
    typed = rows.withColumns({c: F.col(c).cast("double") for c in numeric})
    return merge_repeated(group_filter(typed, filters), ts, keys, "mean", numeric, [])


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream in append mode over what is there, written as Parquet by the executors, and read it back; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """Run `each` over every micro-batch and append what it gives to a Parquet table, which is read back."""

    def write(batch: DataFrame, number: int) -> None:
        each(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and read its in-memory result table (for tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

"""Sinks: partitioned Parquet, CSV or JSON, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_series(long: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of series that are not saved yet."""
    return long.join(saved.select(*keys).distinct(), keys, "left_anti")


def save_series(long: DataFrame, path: str, keys: list[str], saved: DataFrame | None = None) -> DataFrame:
    """Append what is new, in folders by key; the rows that were written."""
    fresh = long if saved is None else new_series(long, saved, keys)
    fresh.repartition(*keys).write.mode("append").partitionBy(*keys).parquet(path)
    return fresh


def save_catalog(long: DataFrame, path: str, key: str, ts: str, value: str) -> None:
    """Append a catalog row (start, end, length, known values, mean) for each series of `long`, in one pass."""
    rows = long.groupBy(key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length"), F.count(value).alias("known"), F.avg(value).alias("mean"))
    rows.write.mode("append").parquet(path)


def save_dataset(df: DataFrame, path: str, ts: str, kind: str = "parquet") -> DataFrame:
    """Write as csv, json or parquet; a one-row description (rows, first, last)."""
    writer = df.write.mode("overwrite")
    getattr(writer.option("header", True) if kind == "csv" else writer, kind)(path)
    return df.agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def save_samples(samples: DataFrame, path: str, split: str = "split", per_file: int = 1000) -> None:
    samples.write.mode("overwrite").partitionBy(split).option("maxRecordsPerFile", per_file).parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def save_results(results: DataFrame, path: str, kind: str = "csv") -> None:
    """Evaluation results as CSV with a header, or as Parquet; nested columns need Parquet."""
    writer = results.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def load_results(spark: SparkSession, path: str, schema: StructType, kind: str = "csv") -> DataFrame:
    """What `save_results` wrote, with the types it had; malformed rows are an error."""
    reader = spark.read.schema(schema)
    return reader.options(header=True, mode="FAILFAST").csv(path) if kind == "csv" else reader.parquet(path)


def usage_rows(calls: DataFrame) -> DataFrame:
    """Rows of the raw usage table from calls (call_id, ts, user, endpoint, code, seconds): the status follows from the HTTP code, and the user is hashed."""
    status = F.when(F.col("code") < 400, "success").when(F.col("code") < 500, "rejected").otherwise("failed")
    return calls.select("call_id", "ts", F.sha2(F.col("user").cast("string"), 256).alias("user_key"), "endpoint", "code", status.alias("status"), "seconds", F.to_date("ts").alias("day"))


def append_usage(calls: DataFrame, path: str) -> None:
    """Append usage rows to the raw table, in folders by day. A stream calls it for each batch through foreachBatch."""
    usage_rows(calls).write.mode("append").partitionBy("day").parquet(path)

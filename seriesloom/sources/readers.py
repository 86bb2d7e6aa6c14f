"""Sources: every reader is a plan over Spark's file sources and prunes to the columns it needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import require_columns
from ..operators.order_statistics import by_keys

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
WIDER = ["tinyint", "smallint", "int", "bigint", "float", "double", "string"]


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """CSV, JSON or Parquet by ending, with required columns checked."""
    kind = "csv" if ".csv" in path else "json" if ".json" in path else "parquet"
    reader = spark.read.options(header=True, inferSchema=schema is None) if kind == "csv" else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = getattr(reader, kind)(path)
    return df if columns is None else require_columns(df, columns).select(*columns)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Several inputs on top of each other with _source_id and the widest type of each column."""
    kinds: dict[str, str] = {}
    for f in frames:
        for c, t in f.dtypes:
            old = kinds.get(c, t)
            kinds[c] = t if old == t else WIDER[max(WIDER.index(t) if t in WIDER else 6, WIDER.index(old) if old in WIDER else 6)]
    widened = [f.select(*[F.col(c).cast(kinds[c]).alias(c) for c in f.columns], F.lit(i).alias("_source_id")) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), widened)


def timestamp_of(df: DataFrame) -> DataFrame:
    """A timestamp from year, month, day and optional hour, minute and second columns, which go."""
    part = lambda c, default: F.col(c).cast("int") if c in df.columns else F.lit(default)
    ts = F.make_timestamp_ntz(part("year", 1970), part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), part("second", 0).cast("decimal(8, 6)"))
    return df.withColumn("timestamp", ts).drop("year", "month", "day", "hour", "minute", "second")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files, one JSON record each, with the file's name."""
    return spark.read.option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def chosen_series(spark: SparkSession, path: str, catalog: DataFrame, condition: Column | str, key: str = "series_id", columns: list[str] | None = None) -> DataFrame:
    """Rows of the series that a condition on their catalog rows (one a series) picks, from a table in folders by `key`.

    It is a semi join on the folders' column: where the picked keys are few enough to be broadcast, Spark opens only their folders;
    a larger choice is an ordinary join. No key passes through the driver."""
    data = spark.read.parquet(path)
    picked = catalog.where(condition).select(F.col(key).alias(key)).distinct()
    found = data.join(picked, key, "left_semi")
    return found if columns is None else found.select(key, *columns)


def column_series(df: DataFrame, keys: list[str], ts: str, columns: list[str] | None = None) -> DataFrame:
    """Each numeric column as a series of its own: (keys, column_id, ts, value), trimmed to its known part.

    A known value lies in that part, so only missing ones are held against its ends; which columns have any is counted first."""
    columns = columns or [c for c, t in df.dtypes if t in NUMERIC and c not in keys and c != ts]
    wide = df.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in columns]).where(F.col(ts).isNotNull())
    long = lambda rows, names: rows.unpivot([*keys, ts], names, "column_id", "value")
    known = long(wide, columns).where("value is not null")
    gaps = wide.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    holed = [c for c in columns if gaps[c]]
    if not holed:
        return known
    ends = known.where(F.col("column_id").isin(holed)).groupBy(*keys, "column_id").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    missing = by_keys(long(wide, holed).where("value is null"), ends, [*keys, "column_id"])
    return known.unionByName(missing.where(F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"))


def series_metadata(long: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Start, end, length and known values of each series."""
    return long.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length"), F.count("value").alias("known"))


def from_column_json(df: DataFrame, payload: str, keys: list[str], columns: list[str]) -> DataFrame:
    """{column: {row: value}} payloads as rows (keys, idx, columns)."""
    parsed = F.from_json(payload, "map<string, map<string, string>>")
    cells = df.select(*keys, F.explode(parsed).alias("_c", "_m")).select(*keys, "_c", F.explode("_m").alias("idx", "_v"))
    return cells.groupBy(*keys, F.col("idx").cast("long").alias("idx")).pivot("_c", columns).agg(F.first("_v"))


def to_column_json(df: DataFrame, keys: list[str], idx: str, columns: list[str]) -> DataFrame:
    """Rows back to {column: {row: value}} payloads, one per key."""
    one = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(idx).cast("string"), F.col(c).cast("string")))))
    return df.groupBy(*keys).agg(F.to_json(F.struct(*[one(c).alias(c) for c in columns])).alias("payload"))


def long_from_arrays(windows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Stored windows as rows (keys, step, columns)."""
    return windows.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("step", "_z")).select(*keys, "step", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def wide_from_long(long: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot(name, names).agg(F.avg(value))


def dated_table(df: DataFrame, ts: str, pattern: str | None = None) -> DataFrame:
    """A text timestamp parsed; rows where it does not parse go."""
    parsed = F.try_to_timestamp(F.col(ts), F.lit(pattern)) if pattern else F.try_to_timestamp(F.col(ts))
    return df.withColumn(ts, parsed.cast("timestamp_ntz")).where(F.col(ts).isNotNull())


def long_groups(df: DataFrame, sizes: list[tuple[list[str], int]]) -> DataFrame:
    """Rows of groups that reach each minimum size, in turn."""
    for keys, least in sizes:
        big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
        df = df.join(big, keys, "left_semi")
    return df


def path_part(pattern: str, group: int = 1, path: str | Column = "_metadata.file_path") -> Column:
    """An attribute that sits in the file path."""
    return F.regexp_extract(path, pattern, group)


def from_value_arrays(df: DataFrame, keys: list[str], start: str, values: str, step: str) -> DataFrame:
    """Series stored as one array per row: (keys, ts, value)."""
    return df.select(*keys, start, F.posexplode(values).alias("_p", "value")).withColumn("ts", (F.col(start) + F.col("_p") * F.expr(step)).cast("timestamp_ntz")).drop("_p", start)


def weather_rows(df: DataFrame, payload: str) -> DataFrame:
    """{"historical": {date: {"hourly": [{"time": "300", ...}]}}} as (ts, parameter, value)."""
    kind = "struct<historical: map<string, struct<hourly: array<map<string, string>>>>>"
    days = df.select(F.explode(F.from_json(payload, kind)["historical"]).alias("day", "_d"))
    hours = days.select("day", F.explode("_d.hourly").alias("_h"))
    at = F.to_timestamp(F.concat("day", F.lit(" "), F.lpad(F.try_element_at("_h", F.lit("time")), 4, "0")), "yyyy-MM-dd HHmm").cast("timestamp_ntz")
    cells = hours.select(at.alias("ts"), F.explode("_h").alias("parameter", "_v")).where("parameter <> 'time'")
    return cells.select("ts", "parameter", F.expr("try_cast(_v as double)").alias("value"))


def queried_samples(samples: DataFrame, predicate: str, fields: list[str], order: str, n: int) -> DataFrame:
    return samples.where(predicate).orderBy(order).limit(n).select(*fields)


def latest_rows(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One result row per key: the latest."""
    return results.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")

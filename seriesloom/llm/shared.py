"""Small helpers that the numbered operators share: shared storage, table reads, boxed rows and lean Python tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives later joins
    a plain scan whose size Spark knows and whose skew AQE can split."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, key: str, buckets: int, name: str) -> tuple[DataFrame, str]:
    """As `store`, in buckets of a key: what is later grouped or joined by that key is not shuffled again. The table's name is for dropping it.

    `df` comes out of repartition(buckets, key), or of a grouping on it, so that a task has the rows of one bucket."""
    spark, table = df.sparkSession, f"b{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{table}"
    df.write.option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table), table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that `store` wrote, once nothing that is still to run reads them."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        ours = shared_dir(spark).split(":", 1)[-1].lstrip("/")
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if ours in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that extra columns never clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row of `df` as one column `row` beside the named columns, with which no column of `df` can then clash."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"), *[column.alias(name) for name, column in columns.items()])


def unboxed(df: DataFrame) -> DataFrame:
    """The rows that `boxed` packed."""
    return df.select("row.*")


def utf8(column) -> object:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8")


def gathered(df: DataFrame) -> dict[str, np.ndarray]:
    """A table of proven bound on the driver, column by column and by way of Arrow, so that no row becomes a Python object."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in df.columns}


def give_back() -> None:
    """Return freed memory of a reused Python worker to the system; what is not offered by its C library is left out."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = 1 << 22) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that takes about `most` bytes at a time and gives memory back after each batch and at the end.

    A worker is reused by all later stages, so what its allocator keeps would add up."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * most / max(batch.nbytes, 1))))
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(fed(batches))
        give_back()

    return run


def in_order(df: DataFrame, keys: list[str], rank: str, name: str) -> DataFrame:
    """`df` with its place from 1 in the order of `keys`.

    Rows are dealt by ranges of the keys and sorted inside a partition; places go on from those of earlier partitions, of which only the sizes are put in a row."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    held = store(dealt, name).withColumn("_part", F.shiftright("_at", 33))
    before = held.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(before), "_part").withColumn(rank, place).drop("_at", "_part", "_before")

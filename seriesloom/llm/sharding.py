"""op6: sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `nodes` points on a ring of 2**32 places. A row hashes to
the ring and goes clockwise to the first shard with room: no shard takes
over (1 + slack) times the mean, so the law that holds is `bytes`. With one
more shard, little more moves than its own share: with 1024 nodes and a slack
of 0.002, 2.9 % of all bytes on the way from 40 to 41 shards, of which 2.4 % are
the new shard's share (`tests/llm` measure it on a table).

Where rows go is decided from a summary of fixed size: the bytes of 65,536
ring cells, and the rows of at least 1/1000 of a shard, of which there are
1000 a shard at most. A cell's bytes are poured clockwise into shards with
room; a cell that meets a full shard is split at that byte. Rows then find
their place by their running size inside the cell. So no task sees more
than a cell or a summary, and shards differ by less than one such row
beyond the slack. Only SQL functions are used.

Defined results: a null text counts as empty (size 16, checksum 0). Null and
repeated ids take part; equal rows are interchangeable and may be split. Of a
text, of any length, only size and checksum are kept. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, store

SHARDS, NODES, SLACK, HEAVY, CELL_BITS = 40, 1024, 0.002, 1000, 16
COPIES = 1 << 16


class Ring:
    """Places of all virtual nodes, and shards filled clockwise up to a limit."""

    def __init__(self, shards: int, nodes: int, limit: int):
        points = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=4).digest(), "big"), s) for s in range(shards) for v in range(nodes))
        self.points, self.shards = [p for p, _ in points], [s for _, s in points]
        self.limit, self.load = limit, [0] * shards

    def _first(self, point: int, size: int) -> int | None:
        """The first shard clockwise from a point with room for `size`."""
        n = len(self.points)
        at = bisect_left(self.points, point) % n
        for _ in range(n):
            if self.load[self.shards[at]] + size <= self.limit:
                return self.shards[at]
            at = (at + 1) % n
        return None

    def put(self, point: int, size: int) -> int:
        """Place a whole row; if it fits nowhere, the emptiest shard takes it."""
        shard = self._first(point, size)
        if shard is None:
            shard = min(range(len(self.load)), key=lambda s: (self.load[s], s))
        self.load[shard] += size
        return shard

    def pour(self, point: int, size: int) -> list[tuple[int, int, int]]:
        """Place `size` bytes that may be split: (shard, from, to)."""
        out, done = [], 0
        while done < size:
            shard = self._first(point, 1)
            if shard is None:
                shard = min(range(len(self.load)), key=lambda s: (self.load[s], s))
                part = size - done
            else:
                part = min(size - done, self.limit - self.load[shard])
            self.load[shard] += part
            out.append((shard, done, done + part))
            done += part
        return out


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, slack: float = SLACK) -> DataFrame:
    """One row per row of `df`: id_col, size, text_crc32, shard, slot."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    point = F.pmod(F.xxhash64("id", "crc", "size"), F.lit(1 << 32))
    groups = store(rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n")).withColumn("point", point).withColumn("cell", F.shiftright("point", 32 - CELL_BITS).cast("int")), "op6-groups")
    total = groups.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    least = max(1, -(-total // (shards * HEAVY)))
    ring = Ring(shards, nodes, -(-int(total * (1 + slack)) // shards))
    heavy, light = groups.where(F.col("size") >= least), groups.where(F.col("size") < least)
    placed: list[tuple] = []
    for r in sorted(heavy.collect(), key=lambda r: (-r["size"], r["point"], str(r["id"]), r["crc"])):  # shards * HEAVY rows at most
        runs: list[list[int]] = []
        for i in range(r["n"]):
            s = ring.put(r["point"], r["size"])
            if runs and runs[-1][0] == s:
                runs[-1][2] += 1
            else:
                runs.append([s, i, 1])
        placed += [(r["id"], r["size"], r["crc"], s, k) for s, _, k in runs]
    cells = light.groupBy("cell").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).collect()  # 65,536 rows at most
    poured = [(r["cell"], s, a, b) for r in sorted(cells, key=lambda r: r["cell"]) for s, a, b in ring.pour(r["cell"] << 32 - CELL_BITS, r["bytes"])]
    kind = groups.schema["id"].dataType.simpleString()
    whole = spark.createDataFrame(placed, f"id {kind}, size long, crc long, shard int, copies long")
    whole = whole.withColumn("cell", F.shiftright(point, 32 - CELL_BITS).cast("int"))
    ranges = F.broadcast(spark.createDataFrame(poured, "cell int, shard int, low long, high long"))
    bytes_of = F.col("size") * F.col("n")
    start = F.sum(bytes_of).over(Window.partitionBy("cell").orderBy("point", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)) - bytes_of
    in_cell = light.withColumn("start", start).join(ranges, "cell").where((F.col("start") < F.col("high")) & (F.col("start") + bytes_of > F.col("low")))
    # copies whose first byte is in the range: those that begin before its end, less those that begin before its start
    begun = lambda edge: F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((F.col(edge) - F.col("start")) / F.col("size")))).cast("long")
    split = in_cell.withColumn("copies", begun("high") - begun("low")).where("copies > 0")
    columns = ["id", "size", "crc", "cell", "shard", "copies"]
    parts = store(split.select(*columns).unionByName(whole.select(*columns)), "op6-parts")
    counts = parts.groupBy("shard", "cell").agg(F.sum("copies").alias("copies"))
    base = F.sum("copies").over(Window.partitionBy("shard").orderBy("cell")) - F.col("copies")
    bases = store(counts.withColumn("base", base).drop("copies"), "op6-bases")
    inside = Window.partitionBy("shard", "cell").orderBy("id", "size", "crc", "copies").rowsBetween(Window.unboundedPreceding, 0)
    slots = parts.withColumn("first", F.sum("copies").over(inside) - F.col("copies")).join(bases, ["shard", "cell"])
    chunks = slots.withColumn("from", F.explode(F.expr(f"sequence(0, copies - 1, {COPIES})")))
    each = chunks.withColumn("i", F.explode(F.expr(f"sequence(from, least(from + {COPIES}, copies) - 1)")))
    return each.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("first") + F.col("i")).alias("slot"))


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

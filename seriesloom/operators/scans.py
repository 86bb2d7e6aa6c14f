"""Ordered scans over series of any length, in two steps.

A series is dealt by quantile edges of its order into buckets, whose sizes give every
row its position; then into chunks of equally many rows. Frames of
bounded reach see copies of the neighbouring chunks' rows; running states are
worked out inside a chunk, summed up over the table of chunks, and carried back. So no
task orders more than a bucket or a chunk, however long a series is.

Whether a table needs this is counted first: at most one chunk of rows in all
is ordered whole. Edges and that count come from one pass over one column."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order_statistics import by_keys

CHUNK = 1 << 14
EDGES = 255


def ordinal(df: DataFrame, column: str) -> Column | None:
    """A number that grows with a numeric or time column; None for other types."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double") if isinstance(kind, T.NumericType) else None


def edges_of(df: DataFrame, column: str, most: int = EDGES) -> tuple[int, list]:
    """The number of rows, and up to `most` values of the column that cut them into parts of about the same size.

    Numbers and times: quantiles of a sketch. Others: the values of the rows whose hashes are smallest, a
    sample of distinct values of bounded size."""
    value = ordinal(df, column)
    if value is not None:
        shares = [i / (most + 1) for i in range(1, most + 1)]
        one = df.select(value.alias("_v")).agg(F.count("*").alias("n"), F.percentile_approx("_v", shares, 10_000).alias("e")).first()
        return one["n"], sorted(set(one["e"] or []))
    n = df.count()
    taken = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(8 * most).collect()
    values = sorted((r[0] for r in taken), key=lambda v: v.encode() if isinstance(v, str) else v)
    return n, values[4::8] if len(values) > most else values


def bucket_of(value: Column, edges: list) -> Column:
    """How many of the sorted edges are at or below a value (null: none), by halving; the value is worked out once, as the one element of an array."""
    if not edges:
        return F.lit(0)
    kind = "string" if isinstance(edges[0], str) else "double"
    among = F.from_json(F.lit(json.dumps(edges)), f"array<{kind}>")  # one literal, not one for each edge
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    found = lambda v: F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(among, n + step - 1) <= v, n + step).otherwise(n))
    return F.get(F.transform(F.array(value), found), F.lit(0))


def placed_in_buckets(df: DataFrame, column: str, most: int = EDGES, name: str = "_b") -> tuple[int, DataFrame]:
    """The number of rows, and `df` with its bucket: equal values share one, and a bucket's rows are about as many as any other's."""
    n, edges = edges_of(df, column, most)
    if n <= CHUNK:  # one task holds them all
        return n, df.withColumn(name, F.lit(0))
    value = ordinal(df, column)
    return n, df.withColumn(name, bucket_of(F.col(column) if value is None else value, edges))


def positioned(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", total: str | None = None, chunk: int = CHUNK, edges: tuple[int, list] | None = None) -> DataFrame:
    """`df` with each row's position from 0 in its series, and the series' size as `total`. Ties in all of `order` are in any order, nulls first.

    `edges`: what `edges_of` gave for the table that `df` was made of, with as many rows at least, so that `df` is not worked out for them."""
    return _positioned(df, keys, order, name, total, chunk, edges)[1]


def _positioned(df: DataFrame, keys: list[str], order: list[str], name: str, total: str | None, chunk: int, edges: tuple[int, list] | None = None) -> tuple[int, DataFrame]:
    n, edges = edges or edges_of(df, order[0])
    w = Window.partitionBy(*keys)
    if n <= chunk:
        out = df.withColumn(name, F.row_number().over(w.orderBy(*order)) - 1)
        return n, out.withColumn(total, F.count("*").over(w)) if total else out
    value = ordinal(df, order[0])
    rows = df.withColumn("_b", bucket_of(F.col(order[0]) if value is None else value, edges))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_k"))
    sizes = sizes.select(*keys, "_b", (F.sum("_k").over(w.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(w).alias("_all"))  # a row per series and bucket
    out = by_keys(rows.withColumn("_i", F.row_number().over(inside) - 1), sizes, [*keys, "_b"])
    out = out.withColumn(name, (F.col("_i") + F.col("_before")).cast("int" if n < 1 << 31 else "long"))
    return n, (out.withColumn(total, F.col("_all")) if total else out).drop("_b", "_i", "_before", "_all")


@dataclass
class Chunks:
    """Rows with `_pos`, `_n` (the series' size), `_chunk` and `_own` (false for a copy out of a neighbouring chunk); `size` rows a chunk, `all` in the table."""

    rows: DataFrame
    keys: list[str]
    size: int
    all: int

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy("_pos")

    def own(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows without copies and without the columns of this module."""
        rows = self.rows if rows is None else rows
        return rows.where("_own").drop("_pos", "_n", "_chunk", "_own")

    def carried(self, rows: DataFrame, **states: tuple[Column, str]) -> DataFrame:
        """`rows` with a state from the chunks before (or behind) theirs: name=(an aggregate over a chunk, `last` for the last known
        one before, `next` for the first known one behind, `sum` for the sum of those before)."""
        table = rows.where("_own").groupBy(*self.keys, "_chunk").agg(*[state.alias(name) for name, (state, _) in states.items()])
        w = Window.partitionBy(*self.keys)
        before, behind = w.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        ways = {"last": lambda c: F.last(c, ignorenulls=True).over(before), "next": lambda c: F.last(c, ignorenulls=True).over(behind), "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))}
        table = table.select(*self.keys, "_chunk", *[ways[way](name).alias(name) for name, (_, way) in states.items()])  # a row per series and chunk
        return by_keys(rows, table, [*self.keys, "_chunk"])


def chunked(df: DataFrame, keys: list[str], order: list[str], before: int = 0, after: int = 0, chunk: int = CHUNK, edges: tuple[int, list] | None = None) -> Chunks:
    """`df` in chunks, each with copies of the `before` rows that precede it and the `after` rows that follow; `edges` as in `positioned`."""
    n, placed = _positioned(df, keys, order, "_pos", "_n", chunk, edges)
    return _dealt(n, placed, keys, before, after, chunk)


def dealt_again(c: Chunks, rows: DataFrame, before: int = 0, after: int = 0) -> Chunks:
    """`rows` of `c`, which has no copies, with copies; positions stay."""
    return _dealt(c.all, rows.drop("_chunk", "_own"), c.keys, before, after, c.size)


def _dealt(n: int, placed: DataFrame, keys: list[str], before: int, after: int, chunk: int) -> Chunks:
    home = F.expr(f"cast(_pos div {chunk} as int)")
    if not before and not after:
        return Chunks(placed.withColumn("_chunk", home).withColumn("_own", F.lit(True)), keys, chunk, n)
    first, last = F.expr(f"cast(greatest(0, _pos - {after}) div {chunk} as int)"), F.expr(f"cast(least(_pos + {before}, _n - 1) div {chunk} as int)")
    return Chunks(placed.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_chunk") == home), keys, chunk, n)


def _composed(maps: dict[str, tuple[str, str]], w: WindowSpec, passes: int, rows: DataFrame) -> DataFrame:
    """Columns (a, b) of each map become those of all maps up to the row, by doubling: each pass puts the map of 2**i rows before under the row's own."""
    for i in range(passes):
        new = {}
        for a, b in maps.values():
            back_a, back_b = F.lag(a, 1 << i).over(w), F.lag(b, 1 << i).over(w)
            new[b] = F.when(back_b.isNull(), F.col(b)).otherwise(F.col(b) + F.col(a) * back_b)
            new[a] = F.when(back_a.isNull(), F.col(a)).otherwise(F.col(a) * back_a)
        rows = rows.withColumns(new)
    return rows


def affine_scan(chunks: Chunks, rows: DataFrame, reach: float | None = None, **maps: tuple[Column, Column]) -> DataFrame:
    """`rows` with y of the recursion y = a * y + b, from 0 before the first row, for each name=(a, b).

    The maps (a, b) compose associatively, so they are put together by doubling inside chunks, then over the
    chunks' totals, and applied: nothing is divided by a power of `a`, so nothing overflows. `reach`: so many rows back, what is left of any `b` is below the precision of a double."""
    names = {name: (f"_a_{name}", f"_b_{name}") for name in maps}
    rows = rows.withColumns({c: x.cast("double") for name, pair in maps.items() for c, x in zip(names[name], pair)})
    whole = max(2, min(chunks.all, math.inf if reach is None else math.ceil(reach)))
    rows = _composed(names, chunks.window, math.ceil(math.log2(min(whole, chunks.size))), rows)
    flat = [c for pair in names.values() for c in pair]
    if chunks.all <= chunks.size:
        return rows.withColumns({name: F.col(b) for name, (_, b) in names.items()}).drop(*flat)
    totals = rows.groupBy(*chunks.keys, "_chunk").agg(F.max_by(F.struct(*flat), "_pos").alias("_t")).select(*chunks.keys, "_chunk", *[F.col(f"_t.{c}").alias(c) for c in flat])
    w = Window.partitionBy(*chunks.keys).orderBy("_chunk")
    totals = _composed(names, w, math.ceil(math.log2(whole / chunks.size + 2)), totals)  # a row per series and chunk
    totals = totals.select(*chunks.keys, "_chunk", *[F.lag(b).over(w).alias(f"_y_{name}") for name, (_, b) in names.items()])
    # Where passes inside a chunk stop at `reach`, `a` is that of fewer rows, and too large; what comes in from before counts for the rows that it reaches.
    out = by_keys(rows, totals, [*chunks.keys, "_chunk"])
    inside = F.lit(True) if whole >= chunks.size else F.col("_pos") % chunks.size < whole
    out = out.withColumns({name: F.col(b) + F.when(inside, F.col(a)).otherwise(F.lit(0.0)) * F.coalesce(f"_y_{name}", F.lit(0.0)) for name, (a, b) in names.items()})
    return out.drop(*flat, *[f"_y_{name}" for name in names])


def running_sum(df: DataFrame, order: str, weight: str, name: str, most: int = EDGES) -> DataFrame:
    """`df` with the inclusive running sum of `weight` by `order`, in two steps over buckets of about equally many rows."""
    _, placed = placed_in_buckets(df, order, most)
    sums = placed.groupBy("_b").agg(F.sum(weight).alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))  # a row per bucket
    inside = F.sum(weight).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_in", inside).join(F.broadcast(before), "_b").withColumn(name, F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")

"""Top-k, sampling and splitting: seeded by hashes, so reruns and retries agree."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import positioned


def draw(*columns: str | Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from row values: the first 13 hexadecimal digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def ordered_windows(windows: DataFrame, keys: list[str], order: list[tuple[str, bool]], n: int) -> DataFrame:
    """The first n windows by several columns: ascending by the window's minimum, descending by its maximum."""
    ends = windows.groupBy(*keys).agg(*[(F.min(c) if up else F.max(c)).alias(f"_{i}") for i, (c, up) in enumerate(order)])
    sort = [F.col(f"_{i}").asc() if up else F.col(f"_{i}").desc() for i, (_, up) in enumerate(order)]
    return windows.join(F.broadcast(ends.orderBy(*sort, *keys).limit(n).select(*keys)), keys, "left_semi")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Spark prunes to n rows per group before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def first_rows_filled(df: DataFrame, keys: list[str], order: list[str], n: int, column: str) -> DataFrame:
    return top_per_group(df, keys, [F.col(c) for c in order], n).withColumn(column, F.coalesce(column, F.lit(0.0)))


def half(df: DataFrame, keys: list[str], order: list[str], second: bool) -> DataFrame:
    placed, middle = positioned(df, keys, order, "_p", "_n"), F.floor(F.col("_n") / 2)
    return placed.where(F.col("_p") >= middle if second else F.col("_p") < middle).drop("_p", "_n")


def share(df: DataFrame, ids: list[str], percent: float, seed: int = 0) -> DataFrame:
    """Rows whose draw is below a percentage."""
    return df.where(draw(*ids, seed=seed) < percent / 100)


def series_split(df: DataFrame, series: str, percent: float, seed: int = 0) -> DataFrame:
    """Whole series into a blind part of a percentage and the rest."""
    return df.withColumn("part", F.when(draw(series, seed=seed) < percent / 100, "blind").otherwise("pretrain"))


def enrichment_sets(series: DataFrame, series_col: str, length: str, k: int, rounds: int) -> DataFrame:
    """Per round, series in hash order are dealt into sets of k; the longest of a set leads."""
    dealt = series.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    dealt = dealt.withColumn("_h", draw(series_col, F.col("round"))).withColumn("_b", F.floor(F.col("_h") * 16))
    place = F.row_number().over(Window.partitionBy("round", "_b").orderBy("_h", series_col)) - 1
    dealt = dealt.withColumn("set", F.floor(place / k))
    lead = F.row_number().over(Window.partitionBy("round", "_b", "set").orderBy(F.desc(length), series_col)) == 1
    return dealt.withColumn("leads", lead).select("round", F.col("_b").alias("bucket"), "set", series_col, "leads")


def noised(df: DataFrame, column: str, ids: list[str], kind: str, level: float, probability: float = 1.0, relative: bool = False) -> DataFrame:
    """Gaussian, Laplace or uniform noise, at a level or at a level times the column's deviation, on a share of the rows."""
    u, v = F.greatest(draw(*ids, seed=1), F.lit(1e-12)), draw(*ids, seed=2)
    unit = {"gaussian": F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v), "laplace": -F.signum(u - 0.5) * F.ln(1 - 2 * F.abs(u - 0.5) + 1e-12), "uniform": 2 * u - 1}[kind]
    scale = df.agg((F.stddev_pop(column) if relative else F.lit(1.0)).alias("_s"))
    hit = draw(*ids, seed=3) < probability
    return df.join(F.broadcast(scale)).withColumn(f"{column}_noisy", F.when(hit, F.col(column) + unit * level * F.col("_s")).otherwise(F.col(column))).drop("_s")  # one row


def thinned(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """One row, drawn by hash, of every `size` neighbouring rows."""
    chunks = positioned(df, keys, order, "_p").withColumn("chunk", F.floor(F.col("_p") / size))
    row = F.struct(*[c for c in df.columns])
    return chunks.groupBy(*keys, "chunk").agg(F.min_by(row, draw(*order, seed=4)).alias("_r")).select("chunk", "_r.*")


def sampled_batches(df: DataFrame, batch: str, n: int) -> DataFrame:
    """All rows of n batches chosen by hash."""
    chosen = df.select(batch).distinct().orderBy(draw(batch), batch).limit(n)
    return df.join(F.broadcast(chosen), batch, "left_semi")


def hash_ratio_split(df: DataFrame, keys: list[str], ids: list[str], train: float, validation: float, seed: int = 0) -> DataFrame:
    """Within each group the first share of rows in hash order trains, the next validates, the rest tests."""
    return _named(positioned(df.withColumn("_h", draw(*ids, seed=seed)), keys, ["_h", *ids], "_p", "_n").drop("_h"), train, validation)


def chronological_split(df: DataFrame, keys: list[str], order: list[str], train: float, validation: float) -> DataFrame:
    return _named(positioned(df, keys, order, "_p", "_n"), train, validation)


def _named(placed: DataFrame, train: float, validation: float) -> DataFrame:
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + validation))
    return placed.withColumn("split", F.when(F.col("_p") < a, "train").when(F.col("_p") < b, "val").otherwise("test")).drop("_p", "_n")


def window_splits(counts: DataFrame, keys: list[str], n: str, size: int, stride: int, train: float, validation: float, from_start: bool = False) -> DataFrame:
    """Window starts of a chronological split that share no rows: (keys, split, start). Windows are aligned to the end of the group
    unless from_start; a group as long as one window has one training window; a group without a training window goes."""
    c = counts.withColumn("_a", F.floor(F.col(n) * train)).withColumn("_b", F.floor(F.col(n) * (train + validation)))
    c = c.withColumn("_a", F.when(F.col(n) == size, F.col(n)).otherwise(F.col("_a"))).withColumn("_b", F.greatest("_a", "_b"))
    zones = F.array(*[F.struct(F.lit(s).alias("split"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for s, lo, hi in (("train", F.lit(0), F.col("_a")), ("val", F.col("_a"), F.col("_b")), ("test", F.col("_b"), F.col(n)))])
    z = c.where(F.col("_a") >= size).select(*keys, F.explode(zones).alias("z")).select(*keys, "z.*").withColumn("k", F.expr(f"cast((hi - lo - {size}) div {stride} as long)")).where(F.col("hi") - F.col("lo") >= size)
    first = F.col("lo") if from_start else F.col("hi") - size - F.col("k") * stride
    return z.select(*keys, "split", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k")), lambda i: first + i * stride)).alias("start"))


def workable_lengths(size: int, stride: int, train: float, validation: float) -> tuple[int, int, int]:
    """Rows that training, validation and test need so that the smallest share which is not 0 has one window and the others have as many more as their shares say; training has one at least."""
    shares = [Fraction(str(train)), Fraction(str(validation)), 1 - Fraction(str(train)) - Fraction(str(validation))]
    least = min(s for s in shares if s > 0)
    counts = [int(s / least) for s in shares]
    counts[0] = max(1, counts[0])
    return tuple(size + (n - 1) * stride if n > 0 else 0 for n in counts)


def partitioned_splits(counts: DataFrame, keys: list[str], n: str, size: int, stride: int, train: float, validation: float, seed: int = 0) -> DataFrame:
    """Window starts (keys, part, split, start, turn) where each group is cut into parts of the least length that has windows of all splits, and each part is split by itself.

    What is left over is a shorter part; a group under that length is one part. A part without a training window goes. `turn` is a draw by
    hash: its order takes the place of a shuffle of the parts."""
    lengths = workable_lengths(size, stride, train, validation)
    whole = sum(lengths)
    last = F.floor((F.greatest(F.col(n), F.lit(1)) - 1) / whole).cast("int")
    parts = counts.select(*keys, F.col(n).alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("part")).withColumn("_rows", F.least(F.lit(whole), F.col("_n") - F.col("part") * whole)).where("_rows > 0")
    exact = 1e-12  # a share of whole numbers, floored, must not fall below them
    split = window_splits(parts.select(*keys, "part", "_rows"), [*keys, "part"], "_rows", size, stride, lengths[0] / whole + exact, lengths[1] / whole + exact)
    return split.withColumn("start", F.col("start") + F.col("part") * whole).withColumn("turn", draw(*keys, "part", seed=seed))


def drop_overlaps(windows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Train and validation windows that overlap a test window go, then training windows that overlap validation; in buckets of one window length."""
    def without(a: DataFrame, b: DataFrame) -> DataFrame:
        near = b.select(*keys, F.col("start").alias("_t"), F.explode(F.array(*[F.floor(F.col("start") / size) + d for d in (-1, 0, 1)])).alias("_b"))
        left = a.withColumn("_b", F.floor(F.col("start") / size))
        met = [left[k] == near[k] for k in [*keys, "_b"]]
        return left.join(near, [*met, F.abs(left["start"] - near["_t"]) < size], "left_anti").drop("_b")

    part = lambda s: windows.where(F.col("split") == s)
    validation = without(part("val"), part("test"))
    train = without(without(part("train"), part("test")), validation)
    return train.unionByName(validation).unionByName(part("test"))


def own_split(df: DataFrame, column: str) -> DataFrame:
    """A split column that the data bring; other values than train, val and test are an error."""
    s = F.lower(F.trim(column))
    return df.withColumn("split", F.when(s.isin("train", "val", "test"), s).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), s))))


def time_split(df: DataFrame, ts: str, train_end, validation_end) -> DataFrame:
    at = lambda v: F.lit(v).cast("timestamp_ntz")
    return df.withColumn("split", F.when(F.col(ts) < at(train_end), "train").when(F.col(ts) < at(validation_end), "val").otherwise("test"))


def cut_then_ratio(df: DataFrame, ts: str, cut, ids: list[str], validation: float) -> DataFrame:
    """At or before the cut: train; of the rest a share, by hash, validates."""
    late = draw(*ids, seed=5) < validation
    return df.withColumn("split", F.when(F.col(ts) <= F.lit(cut).cast("timestamp_ntz"), "train").when(late, "val").otherwise("test"))


def rolling_origins(df: DataFrame, keys: list[str], ts: str, first, last, step: str, horizon: str) -> DataFrame:
    """Every row with each origin for which it is history or target."""
    at = lambda v: F.lit(v).cast("timestamp_ntz")
    origins = df.withColumn("origin", F.explode(F.sequence(at(first), at(last), F.expr(step))))
    part = F.when(F.col(ts) <= F.col("origin"), "history").when(F.col(ts) <= F.col("origin") + F.expr(horizon), "target")
    return origins.withColumn("part", part).where("part is not null")


def forecast_windows(ends: DataFrame, low: str, high: str, stride_days: int, most: int = 250) -> DataFrame:
    """Expanding windows: origins every stride up to the end, the end itself added; more than `most` origins are an error."""
    seq = F.array_distinct(F.concat(F.sequence(low, high, F.expr(f"interval {stride_days} days")), F.array(high)))
    counted = F.when(F.size(seq) > most, F.raise_error(F.lit(f"more than {most} forecast origins"))).otherwise(seq)
    return ends.withColumn("origin", F.explode(counted))

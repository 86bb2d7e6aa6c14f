"""Sliding windows, lags, rolling statistics and gap filling over ordered series.

Ordered steps run on chunks of a series (module `scans`), so one long series
spreads over tasks. A row goes to each window that holds it by an explode of window numbers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import by_keys, settled
from .scans import CHUNK, Chunks, affine_scan, bucket_of, chunked, dealt_again, edges_of, ordinal, positioned

def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", total: str | None = None, chunk: int = CHUNK, edges: tuple[int, list] | None = None) -> DataFrame:
    """Position from 0 inside each series, and the series' size if `total` names a column."""
    return positioned(df, keys, order, name, total, chunk, edges)


def sliding_windows(df: DataFrame, keys: list[str], order: list[str], size: int, stride: int, chunk: int = CHUNK) -> DataFrame:
    """Rows with window_idx and step (0 .. size - 1); a series of n rows has (n - size) // stride + 1 windows."""
    placed = numbered(df, keys, order, "pos", "_n", chunk).where(F.col("_n") >= size)
    first = F.expr(f"greatest(0, cast(ceil((pos - {size - 1}) / {stride}) as int))")
    last = F.expr(f"cast(least(pos div {stride}, (_n - {size}) div {stride}) as int)")
    spread = placed.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    return spread.withColumn("window_idx", F.explode(F.sequence("_first", "_last"))).withColumn("step", F.col("pos") - F.col("window_idx") * stride).drop("_n", "_first", "_last")


def window_arrays(windows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per window with one array per column, in step order."""
    packed = F.array_sort(F.collect_list(F.struct("step", *columns)))
    rows = windows.groupBy(*keys, "window_idx").agg(packed.alias("_rows"))
    return rows.select(*keys, "window_idx", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def standardized_windows(windows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Each window scaled by its own mean and sample deviation; a zero or missing scale counts as 1; nulls stay."""
    w = Window.partitionBy(*keys, "window_idx")
    scale = F.coalesce(F.nullif(F.stddev_samp(column).over(w), F.lit(0.0)), F.lit(1.0))
    return windows.withColumn("scaled", (F.col(column) - F.avg(column).over(w)) / scale)


def history_and_target(arrays: DataFrame, column: str, history: int, horizon: int) -> DataFrame:
    """Split window arrays; windows with a null are dropped."""
    whole = arrays.where(~F.exists(column, lambda x: x.isNull()))
    return whole.withColumn("history", F.slice(column, 1, history)).withColumn("target", F.slice(column, history + 1, horizon))


def blocks(df: DataFrame, keys: list[str], order: list[str], size: int, history: int, chunk: int = CHUNK) -> DataFrame:
    """Windows without overlap; the incomplete last one goes; `part` is history or target."""
    placed = numbered(df, keys, order, chunk=chunk).withColumn("block", F.expr(f"cast(pos div {size} as int)"))
    full = F.count("*").over(Window.partitionBy(*keys, "block"))
    part = F.when(F.col("pos") % size < history, "history").otherwise("target")
    return placed.withColumn("_n", full).where(F.col("_n") == size).withColumn("part", part).drop("_n")


def lag_or_zero(df: DataFrame, keys: list[str], order: list[str], column: str, size: int, chunk: int = CHUNK) -> DataFrame:
    """The value `size` rows back; 0 in the first `size` rows."""
    c = chunked(df, keys, order, before=size, chunk=chunk)
    return c.own(c.rows.withColumn(f"{column}_lag_{size}", F.when(F.col("_pos") < size, F.lit(0.0)).otherwise(F.lag(column, size).over(c.window))))


def fill_both_ways(column: str, keys: list[str], order: list[str], default: object | None = None) -> Column:
    """Forward fill, then backward fill, then a default, as an expression: for series that one task can order; `filled_both_ways` takes longer ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])  # the first known value behind is the last one before in reversed order
    past, future = (F.last(column, ignorenulls=True).over(x.rowsBetween(Window.unboundedPreceding, 0)) for x in (w, back))
    return F.coalesce(past, future, *([] if default is None else [F.lit(default)]))


def filled_both_ways(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column | str], default: object | None = None, chunk: int = CHUNK) -> DataFrame:
    """Each named column: a value, or the last known one before it, or the first known one behind it, or a default."""
    c = chunked(df, keys, order, chunk=chunk)
    return c.own(_filled(c, c.rows, columns, default))


def _filled(c: Chunks, rows: DataFrame, columns: dict[str, Column | str], default: object | None = None) -> DataFrame:
    """`filled_both_ways` over rows of chunks, without copies."""
    values = {name: F.col(v) if isinstance(v, str) else v for name, v in columns.items()}
    rows = rows.withColumns({f"_v_{name}": v for name, v in values.items()})
    past, future = c.window.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*c.keys, "_chunk").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    known = lambda name: F.when(F.col(f"_v_{name}").isNotNull(), F.col("_pos"))
    states = {f"_p_{n}": (F.max_by(f"_v_{n}", known(n)), "last") for n in values} | {f"_f_{n}": (F.min_by(f"_v_{n}", known(n)), "next") for n in values}
    out = c.carried(rows, **states)
    filled = {
        n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(past), f"_p_{n}", F.last(f"_v_{n}", ignorenulls=True).over(future), f"_f_{n}", *([] if default is None else [F.lit(default)]))
        for n in values
    }
    return out.withColumns(filled).drop(*[f"_v_{n}" for n in values], *states)


def many_lags(df: DataFrame, keys: list[str], order: list[str], column: str, lags: list[int], chunk: int = CHUNK) -> DataFrame:
    """One column per lag; gaps at the ends are filled forward, backward, then with 0."""
    c = chunked(df, keys, order, before=max(lags), chunk=chunk)
    back = c.rows.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(c.window) for k in lags}).where("_own")
    return c.own(_filled(c, back, {f"{column}_lag_{k}": f"{column}_lag_{k}" for k in lags}, 0.0))


def _ewm(c: Chunks, df: DataFrame, value: str, alpha: float) -> DataFrame:
    """The rows of `c`, which are those of `df`, with _mean and _std: exponential mean and deviation with decaying weights of the rows that have a value, sample correction included."""
    w, x = 1 - alpha, F.col(value).cast("double")
    one, v = F.when(x.isNotNull(), 1.0).otherwise(0.0), F.coalesce(x - F.col("_base"), F.lit(0.0))
    centre = settled(df.groupBy(*c.keys).agg(F.avg(value).alias("_base")))
    rows = by_keys(c.rows, centre, c.keys)
    sums = affine_scan(c, rows, 46 / -math.log(w) if 0 < w < 1 else None, _k=(F.lit(w), one), _kk=(F.lit(w * w), one), _kx=(F.lit(w), v), _kxx=(F.lit(w), v * v))
    mean, full = F.try_divide(F.col("_kx"), F.col("_k")), F.col("_k") * F.col("_k")
    variance = F.greatest(F.try_divide(F.col("_kxx"), F.col("_k")) - mean * mean, F.lit(0.0))
    # With one value so far, both sums of weights agree but for rounding, and there is no deviation.
    unbiased = F.when(full - F.col("_kk") > 1e-12 * full, variance * full / (full - F.col("_kk")))
    return sums.withColumn("_mean", mean + F.col("_base")).withColumn("_std", F.sqrt(unbiased)).drop("_k", "_kk", "_kx", "_kxx", "_base")


def ema(df: DataFrame, keys: list[str], order: list[str], column: str, span: float, adjust: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Exponential moving mean, as column_ema, with alpha = 2 / (span + 1).

    Adjusted: weights decay by a row, known values count, and column_ema_std has the deviation with the sample correction.
    Otherwise the recursion y = (1 - alpha) * y + alpha * x from the first known value, where after g rows without
    a value the old y weighs (1 - alpha) ** g against alpha. A row without a value keeps the mean before it; before
    the first known value there is none."""
    alpha = 2 / (span + 1)
    c = chunked(df, keys, order, chunk=chunk)
    if adjust:
        out = _ewm(c, df, column, alpha)
        return c.own(out.withColumnRenamed("_mean", f"{column}_ema").withColumnRenamed("_std", f"{column}_ema_std"))
    x = F.col(column).cast("double")
    known = F.when(x.isNotNull(), F.col("_pos"))
    rows = c.carried(c.rows.withColumn("_at", known), _past=(F.max("_at"), "last"))
    before = F.coalesce(F.last("_at", ignorenulls=True).over(c.window.rowsBetween(Window.unboundedPreceding, -1)), F.col("_past"))
    rows = rows.withColumn("_old", F.pow(F.lit(1 - alpha), F.col("_pos") - before))  # null at the first known value
    share = F.col("_old") / (F.col("_old") + alpha)
    a = F.when(x.isNull(), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))
    b = F.when(x.isNull(), 0.0).otherwise(x * F.coalesce(1 - share, F.lit(1.0)))
    some = F.coalesce(F.max("_at").over(c.window.rowsBetween(Window.unboundedPreceding, 0)), F.col("_past")).isNotNull()
    out = affine_scan(c, rows.withColumn("_some", some), _y=(a, b))
    return c.own(out.withColumn(f"{column}_ema", F.when(F.col("_some"), F.col("_y")))).drop("_at", "_past", "_old", "_some", "_y")


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], column: str, size: int, chunk: int = CHUNK) -> DataFrame:
    """Mean of the known values among the last `size` rows."""
    c = chunked(df, keys, order, before=size - 1, chunk=chunk)
    return c.own(c.rows.withColumn(f"{column}_mean_{size}", F.avg(column).over(c.window.rowsBetween(1 - size, 0))))


def rolling_mean_in_time(df: DataFrame, keys: list[str], ts: str, column: str, seconds: float, buckets: int = 255) -> DataFrame:
    """Mean of the known values in the `seconds` up to and with each row's time, those that are exactly so old left out.

    `ts` is a timestamp or a date. Rows of the same time see each other. A row without a time has no mean.
    Time is cut into cells of that length. A row sees its own cell up to its time, a running sum, and the later part of the cell before, a running sum
    from behind, for which each row stands in the next cell as well, at its time plus the length. So a row costs the same however many it sees, and nothing is subtracted.
    Inside a cell, buckets of about equally many rows are summed up by themselves, and the sums of the other buckets are carried over."""
    day = df.schema[ts].dataType.simpleString() == "date"
    span = round(seconds * 1_000_000)
    at = df.withColumn("_at", (ordinal(df, ts) * (86_400_000_000 if day else 1)).cast("long"))
    edges, x = edges_of(at, "_at", buckets)[1], F.col(column).cast("double")
    now = at.select(*keys, "_at", F.when(F.col("_at").isNotNull(), x).alias("_new"), F.struct(*df.columns).alias("_row"))
    old = at.where(F.col("_at").isNotNull() & x.isNotNull()).select(*keys, (F.col("_at") + span).alias("_at"), x.alias("_old"))
    rows = now.unionByName(old, allowMissingColumns=True).withColumn("_cell", F.expr(f"(_at - pmod(_at, {span}L)) div {span}L")).withColumn("_b", bucket_of(F.col("_at"), edges))
    part, cell = Window.partitionBy(*keys, "_cell", "_b"), Window.partitionBy(*keys, "_cell")
    upto, behind = part.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0), part.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    parts = [("_new", upto, cell.orderBy("_b")), ("_old", behind, cell.orderBy(F.desc("_b")))]
    totals = rows.groupBy(*keys, "_cell", "_b").agg(*[f(c).alias(f"{c}_{f.__name__}") for c, _, _ in parts for f in (F.sum, F.count)])
    totals = totals.select(*keys, "_cell", "_b", *[F.sum(f"{c}_{f}").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{c}_{f}") for c, _, w in parts for f in ("sum", "count")])  # a row per series, cell and bucket
    inside = rows.withColumns({f"_in{c}_{f.__name__}": f(c).over(w) for c, w, _ in parts for f in (F.sum, F.count)}).where("_row is not null")
    met = by_keys(inside, totals, [*keys, "_cell", "_b"])
    over = lambda f: sum(F.coalesce(n, F.lit(0)) for c, _, _ in parts for n in (f"_in{c}_{f}", f"{c}_{f}"))
    mean = F.when(F.col("_at").isNotNull(), F.try_divide(over("sum"), over("count")))
    return met.select("_row.*", mean.alias(f"{column}_mean"))


def gaussian_smooth(df: DataFrame, keys: list[str], order: list[str], column: str, sigma: float, chunk: int = CHUNK) -> DataFrame:
    """Gaussian filter over four deviations to both sides; a series goes on as its mirror image at both ends, and as often as that takes.

    Missing values are filled from both sides before, and are missing afterwards."""
    reach = int(4 * sigma + 0.5)
    c = chunked(df, keys, order, chunk=chunk)
    placed = _filled(c, c.rows, {"_x": column}).drop("_chunk", "_own")
    # A row stands at 2nm + pos and, mirrored, at 2nm - 1 - pos for every whole m.
    turns = F.sequence(F.floor(F.lit(-reach) / (2 * F.col("_n"))).cast("int") - 1, F.ceil(F.lit(reach) / (2 * F.col("_n"))).cast("int") + 1)
    at = F.flatten(F.transform(turns, lambda m: F.array(2 * F.col("_n") * m + F.col("_pos"), 2 * F.col("_n") * m - 1 - F.col("_pos"))))
    near = F.filter(at, lambda p: (p >= -reach) & (p < F.col("_n") + reach))
    spread = placed.withColumn("_at", F.explode(near))
    home, first, last = F.floor(F.col("_at") / chunk), F.floor((F.col("_at") - reach) / chunk), F.floor((F.col("_at") + reach) / chunk)
    spread = spread.withColumn("_own", F.col("_at") == F.col("_pos")).withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    gs = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = math.fsum(gs)
    # A row's neighbours in its chunk are those at the places next to it, so the sum is one of lags.
    near = {f"_x{i}": F.lag("_x", reach - i).over(w) for i in range(2 * reach + 1)}
    smooth = F.when(F.col(column).isNotNull(), reduce(lambda a, b: a + b, [F.col(x) * (g / total) for x, g in zip(near, gs, strict=True)]))
    out = spread.withColumns(near).where(F.col("_own") & (F.col("_chunk") == F.col("_home")))
    return out.withColumn(f"{column}_smooth", smooth).drop("_x", "_pos", "_n", "_at", "_own", "_home", "_chunk", *near)


def median_of(values: Column) -> Column:
    """The median of an array without nulls; null of an empty one."""
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.get(F.transform(F.array(F.sort_array(values)), middle), F.lit(0))


def volatility(df: DataFrame, keys: list[str], order: list[str], column: str, size: int, baseline: int, chunk: int = CHUNK) -> DataFrame:
    """Three deviations of a series, each against the mean of its own last `baseline` rows, and their mean as a score.

    roll_std and roll_mad: sample deviation, and median absolute deviation from the median, of the last `size` values; ewm_std:
    exponential deviation of span `size`. Each score is (x - base) / base; a score that is undefined, or has a
    base of 0, is left out of the mean. A window or baseline with fewer rows, or a missing value, is undefined."""
    plain = chunked(df, keys, order, chunk=chunk)
    c = dealt_again(plain, _ewm(plain, df, column, 2 / (size + 1)).drop("_mean").withColumnRenamed("_std", "ewm_std"), before=size + baseline - 2)
    near, far = c.window.rowsBetween(1 - size, 0), c.window.rowsBetween(1 - baseline, 0)
    full = F.count(column).over(near) == size
    rows = c.rows.withColumn("roll_std", F.when(full, F.stddev_samp(column).over(near))).withColumn("_held", F.when(full, F.collect_list(column).over(near)))
    rows = rows.withColumn("_med", median_of(F.col("_held"))).withColumn("roll_mad", median_of(F.transform("_held", lambda x: F.abs(x - F.col("_med"))))).drop("_held", "_med")
    names = ["roll_std", "roll_mad", "ewm_std"]
    rows = rows.withColumns({f"_base_{n}": F.when(F.count(n).over(far) == baseline, F.avg(n).over(far)) for n in names})
    scores = F.array_compact(F.array(*[F.try_divide(F.col(n) - F.col(f"_base_{n}"), F.col(f"_base_{n}")) for n in names]))
    rows = rows.withColumn("_s", scores).withColumn("score", F.try_divide(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x), F.size("_s")))
    return c.own(rows).drop("_s", *[f"_base_{n}" for n in names])


def _deviation(x: Column, back: str) -> Column:
    """|x - mean| / (sample deviation + 1e-6) against an array of values."""
    n, total = F.size(back), lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    mean = F.try_divide(total(F.col(back)), n)
    spread = F.sqrt(F.try_divide(F.aggregate(F.transform(back, lambda v: F.pow(v - mean, 2)), F.lit(0.0), lambda a, v: a + v), n - 1))
    return F.abs(x - mean) / (spread + 1e-6)


def lagged_slot_score(df: DataFrame, keys: list[str], order: list[str], column: str, period: int, times: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Deviation from mean and spread of the values 1 .. times periods back, as slot_score."""
    c = chunked(df, keys, order, before=times * period, chunk=chunk)
    back = F.array_compact(F.array(*[F.lag(column, i * period).over(c.window) for i in range(1, times + 1)]))
    return c.own(c.rows.withColumn("_back", back).withColumn("slot_score", _deviation(F.col(column), "_back"))).drop("_back")


def pattern_score(df: DataFrame, keys: list[str], ts: str, column: str, period: int, times: int = 4, hours: bool = True, chunk: int = CHUNK) -> DataFrame:
    """slot_score, hour_score and weekday_score, and as pattern_score the mean of those that are defined.

    They are |x - mean| / (sample deviation + 1e-6) against the values 1 .. times periods back, those of the same hour (with `hours`) and those of the same weekday."""
    out = lagged_slot_score(df, keys, [ts], column, period, times, chunk)
    names = ["slot_score"]
    for name, part in (("hour_score", F.hour(ts)), ("weekday_score", F.dayofweek(ts)))[0 if hours else 1 :]:
        stats = df.groupBy(*keys, part.alias("_part")).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
        out = by_keys(out.withColumn("_part", part), stats, [*keys, "_part"])
        out = out.withColumn(name, F.abs(F.col(column) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_part", "_m", "_s")
        names.append(name)
    known = F.array_compact(F.array(*names))
    return out.withColumn("_k", known).withColumn("pattern_score", F.try_divide(F.aggregate("_k", F.lit(0.0), lambda a, x: a + x), F.size("_k"))).drop("_k")


def long_term_score(df: DataFrame, keys: list[str], order: list[str], column: str, periods: int = 12, chunk: int = CHUNK) -> DataFrame:
    """Deviation from mean and spread of the previous periods."""
    c = chunked(df, keys, order, before=periods, chunk=chunk)
    w = c.window.rowsBetween(-periods, -1)
    return c.own(c.rows.withColumn("long_score", F.abs(F.col(column) - F.avg(column).over(w)) / (F.stddev_samp(column).over(w) + 1e-6)))


def segments(df: DataFrame, keys: list[str], order: list[str], ts: str, least: int, chunk: int = CHUNK) -> DataFrame:
    """A new segment starts where time goes backwards in the given row order; short segments go."""
    c = chunked(df, keys, order, before=1, chunk=chunk)
    rows = c.rows.withColumn("_back", F.when(F.col(ts) < F.lag(ts).over(c.window), 1).otherwise(0)).where("_own")
    rows = c.carried(rows, _before=(F.sum("_back"), "sum"))
    rows = rows.withColumn("segment", F.sum("_back").over(c.window.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    return large_groups(c.own(rows).drop("_back", "_before"), [*keys, "segment"], least)


def large_groups(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows: counts come from a map-side combined aggregate."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(counts, keys, "left_semi")


def relative_changes(df: DataFrame, keys: list[str], order: list[str], column: str, chunk: int = CHUNK, edges: tuple[int, list] | None = None) -> DataFrame:
    """First difference and relative change; null where there is no base."""
    c = chunked(df, keys, order, before=1, chunk=chunk, edges=edges)
    before = F.lag(column).over(c.window)
    return c.own(c.rows.withColumn("change", F.col(column) - before).withColumn("relative", F.try_divide(F.col(column) - before, before)))


def interpolate(df: DataFrame, keys: list[str], order: list[str], column: str, chunk: int = CHUNK, edges: tuple[int, list] | None = None) -> DataFrame:
    """Linear interpolation by position; edges take the nearest value; a series of nulls becomes 0. `edges` as in `scans.positioned`."""
    c = chunked(df, keys, order, chunk=chunk, edges=edges)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(column).alias("v")))
    rows = c.carried(c.rows.withColumn("_k", known), _past=(F.max("_k"), "last"), _next=(F.min("_k"), "next"))
    past, back = c.window.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_a", F.coalesce(F.last("_k", ignorenulls=True).over(past), "_past")).withColumn("_c", F.coalesce(F.last("_k", ignorenulls=True).over(back), "_next"))
    between = F.col("_a.v") + (F.col("_c.v") - F.col("_a.v")) * F.try_divide(F.col("_pos") - F.col("_a.p"), F.col("_c.p") - F.col("_a.p"))
    out = out.withColumn(f"{column}_filled", F.coalesce(F.col(column), between, F.col("_a.v"), F.col("_c.v"), F.lit(0.0)))
    return c.own(out).drop("_k", "_a", "_c", "_past", "_next")


def fill_mean(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Nulls become the series mean, 0 if there is none."""
    mean = df.groupBy(*keys).agg(F.avg(column).alias("_mean"))
    return df.join(mean, keys).withColumn(f"{column}_filled", F.coalesce(column, "_mean", F.lit(0.0))).drop("_mean")


def trim(df: DataFrame, keys: list[str], ts: str, column: str) -> DataFrame:
    """Rows between the first and the last known value of each series."""
    ends = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return df.join(ends, keys).where(F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")

"""Scores of forecasts and distances between real and synthetic samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import by_keys, with_quantiles
from .scans import CHUNK, chunked, positioned


def history_scaled(df: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, MSE, MAPE (a fraction, zero actuals left out) and NMAE (over the history's deviation) of rows (actual, forecast, history)."""
    a, f = F.when(~F.col("history"), F.col("actual")), F.col("forecast")
    out = df.groupBy(*keys).agg(F.avg(F.abs(a - f)).alias("mae"), F.avg(F.pow(a - f, 2)).alias("mse"), F.avg(F.when(a != 0, F.abs((a - f) / F.nullif(a, F.lit(0.0))))).alias("mape"), F.stddev_pop(F.when(F.col("history"), F.col("actual"))).alias("_s"))
    return out.withColumn("nmae", F.try_divide("mae", "_s")).drop("_s")


def forecast_metrics(df: DataFrame, keys: list[str], zeros: bool = False) -> DataFrame:
    """RMSE, NMAE (over the mean absolute actual), MAE, MSE, MAPE and SMAPE in percent, mean residual.

    MAPE and SMAPE leave zero actuals out; with `zeros` they count, so one makes MAPE an infinity, or NaN if its forecast is 0 as well (which makes SMAPE NaN, too)."""
    a, f = F.col("actual"), F.col("forecast")
    gap = F.abs(a - f)
    undefined = F.when(gap == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    share = lambda part, whole: F.when(whole != 0, part / F.nullif(whole, F.lit(0.0))).otherwise(undefined)
    counted = lambda c: c if zeros else F.when(a != 0, c)
    return df.where("actual is not null").groupBy(*keys).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.try_divide(F.avg(gap), F.avg(F.abs(a))).alias("nmae"), F.avg(gap).alias("mae"), F.avg(gap * gap).alias("mse"),
        (F.avg(counted(share(gap, F.abs(a)))) * 100).alias("mape"), (F.avg(counted(share(2 * gap, F.abs(a) + F.abs(f)))) * 100).alias("smape"), F.avg(a - f).alias("residual"),
    )


def channel_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """MAPE, median APE and SMAPE in percent with 1e-10 in the denominators."""
    a, gap = F.col("actual"), F.abs(F.col("actual") - F.col("forecast"))
    ape = gap / (F.abs(a) + 1e-10) * 100
    out = df.groupBy(*keys).agg(F.avg(ape).alias("mape"), (F.avg(2 * gap / (F.abs(a) + F.abs("forecast") + 1e-10)) * 100).alias("smape"))
    return with_quantiles(out, df, keys, ape, {"mdape": 0.5})


def crps(df: DataFrame, keys: list[str], member: str, actual: float | Column) -> DataFrame:
    """(keys, crps): E|X - y| - E|X - X'| / 2 of each group's ensemble, one member a row, null members left out. No array holds a group.

    Members count as their distance from `actual`, so sums of doubles keep their precision at any size of the values."""
    y = F.lit(actual) if isinstance(actual, float) else actual.cast("double")
    counts = df.where(F.col(member).isNotNull()).groupBy(*keys, (F.col(member).cast("double") - y).alias("_x")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = by_keys(counts.withColumn("_i", before), counts.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    # Members of one value take the places _i + 1 .. _i + _n: the sum of (2 * place - all - 1) is _n * (2 * _i + _n - all).
    share = F.col("_n") / F.col("_all")
    gap, spread = F.sum(F.abs("_x") * share), F.sum(F.col("_x") * share * ((2 * F.col("_i") + F.col("_n") - F.col("_all")) / F.col("_all")))
    return placed.groupBy(*keys).agg((gap - spread).alias("crps"))


def mean_forecast(df: DataFrame, keys: list[str]) -> DataFrame:
    """History mean on target rows."""
    mean = df.where("history").groupBy(*keys).agg(F.avg("actual").alias("forecast"))
    return df.join(mean, keys, "left")


#: Candidates of `held_back`: the mean and the last value of the history, its last period again, and the line from its first to its last value.
CANDIDATES = ["drift", "last", "mean", "seasonal"]


def held_back(df: DataFrame, keys: list[str], order: list[str], value: str, tail: int, period: int) -> DataFrame:
    """The last `tail` rows of each series, long by candidate: (keys, pos, model, actual, forecast), forecast from the rows before them.

    A candidate without a forecast (a history shorter than a period, or of one row for the drift) gives null."""
    placed = positioned(df.select(*keys, *order, F.col(value).alias("actual")), keys, order, "pos", "_n")
    cut = F.col("_n") - tail
    past = placed.where(F.col("pos") < cut)
    known = past.groupBy(*keys).agg(F.avg("actual").alias("mean"), F.max_by("actual", "pos").alias("last"), F.min_by("actual", "pos").alias("_first"), F.count("*").alias("_k"))
    season = past.where(F.col("pos") >= cut - period).select(*keys, ((F.col("pos") - cut + period) % period).alias("_p"), F.col("actual").alias("seasonal"))
    rows = by_keys(placed.where(F.col("pos") >= cut).withColumn("_p", (F.col("pos") - cut) % period), known, keys)
    rows = by_keys(rows, season, [*keys, "_p"], "left")
    ahead = F.col("pos") - F.col("_k") + 1
    rows = rows.withColumn("drift", F.col("last") + ahead * F.try_divide(F.col("last") - F.col("_first"), F.col("_k") - 1)).withColumn("seasonal", F.when(F.col("_k") >= period, F.col("seasonal")))
    return rows.unpivot([*keys, "pos", "actual"], CANDIDATES, "model", "forecast")


def routed(scores: DataFrame, keys: list[str], model: str, metric: str) -> DataFrame:
    """(keys, model, metric): the model with the smallest validation metric per series; metrics that agree to nine decimals tie, and ties go by name; models without a metric never win."""
    best = F.min_by(F.struct(metric, model), F.struct(F.round(metric, 9), model)).alias("_m")
    return scores.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best).select(*keys, F.col(f"_m.{model}").alias(model), F.col(f"_m.{metric}").alias(metric))


def route(df: DataFrame, keys: list[str], order: list[str], value: str, tail: int, period: int) -> DataFrame:
    """(keys, model, mae): the candidate whose forecasts of the held-back tail are best."""
    forecasts = held_back(df, keys, order, value, tail, period)
    return routed(forecasts.groupBy(*keys, "model").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae")), keys, "model", "mae")


def _sides(a: DataFrame, b: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column_name, v, _a): the known values of the columns of both tables, _a = 1 for those of the first."""
    long = lambda df, side: df.select(*[F.col(c).cast(kind).alias(c) for c in columns]).unpivot([], columns, "column_name", "v").withColumn("_a", F.lit(side))
    return long(a, 1).unionByName(long(b, 0)).where("v is not null")


def _divergences(shares: DataFrame) -> DataFrame:
    """(column_name, jsd): root of the Jensen-Shannon divergence (natural log) from rows (n_a, n_b) per column and bin; 1 where a side has no rows counts as null."""
    t = shares.groupBy("column_name").agg(F.sum("n_a").alias("ta"), F.sum("n_b").alias("tb"))
    p, q = F.try_divide("n_a", "ta"), F.try_divide("n_b", "tb")
    m = (p + q) / 2
    kl = lambda x: F.sum(F.when(x > 0, x * F.ln(x / m)).when(x == 0, 0.0))
    return by_keys(shares, t, ["column_name"]).groupBy("column_name").agg(F.sqrt(F.greatest(F.lit(0.0), (kl(p) + kl(q)) / 2)).alias("jsd"))


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("column_name", *by).agg(F.sum("_a").alias("n_a"), F.sum(1 - F.col("_a")).alias("n_b"))


def categorical_distances(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, jsd) over the values of all columns."""
    return _divergences(_counted(_sides(a, b, columns, "string"), "v"))


def continuous_distances(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, jsd) over Freedman-Diaconis bins of each column's pooled values."""
    both = _sides(a, b, columns, "double")
    s = with_quantiles(both.groupBy("column_name").agg(F.count("*").alias("n"), F.min("v").alias("lo")), both, ["column_name"], "v", {"q1": 0.25, "q3": 0.75})
    width = F.coalesce(F.nullif(2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n"), F.lit(1 / 3)), F.lit(0.0)), F.lit(1.0))
    binned = by_keys(both, s, ["column_name"]).withColumn("bin", F.floor((F.col("v") - F.col("lo")) / width))
    return _divergences(_counted(binned, "bin"))


def earth_movers_distances(a: DataFrame, b: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """(column_name, emd): the area between both distribution functions of each column, by running sums in chunks, so no task orders a whole column."""
    steps = _counted(_sides(a, b, columns, "double"), "v")
    totals = steps.groupBy("column_name").agg(F.sum("n_a").alias("ta"), F.sum("n_b").alias("tb"))
    steps = by_keys(steps, totals, ["column_name"]).withColumn("d", F.try_divide("n_a", "ta") - F.try_divide("n_b", "tb"))
    c = chunked(steps, ["column_name"], ["v"], after=1, chunk=chunk)
    run = c.carried(c.rows, _before=(F.sum("d"), "sum"))
    run = run.withColumn("f", F.sum("d").over(c.window.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")).withColumn("_next", F.lead("v").over(c.window))
    return run.where("_own").groupBy("column_name").agg(F.coalesce(F.sum(F.abs("f") * (F.col("_next") - F.col("v"))), F.lit(0.0)).alias("emd"))


def report(a: DataFrame, b: DataFrame, continuous: list[str], discrete: list[str], jsd: float = 0.1, emd: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """One row per column of two tables: column_name, kind, jsd, emd (null for discrete ones), emd_share (emd over the pooled range) and whether jsd or emd_share passes its threshold."""
    pooled = _sides(a, b, continuous, "double").groupBy("column_name").agg((F.max("v") - F.min("v")).alias("_range")) if continuous else None
    parts = []
    if continuous:
        both = by_keys(by_keys(continuous_distances(a, b, continuous), earth_movers_distances(a, b, continuous, chunk), ["column_name"]), pooled, ["column_name"])
        parts.append(both.select("column_name", F.lit("continuous").alias("kind"), "jsd", "emd", F.coalesce(F.try_divide("emd", "_range"), F.lit(0.0)).alias("emd_share")))
    if discrete:
        none = F.lit(None).cast("double")
        parts.append(categorical_distances(a, b, discrete).select("column_name", F.lit("discrete").alias("kind"), "jsd", none.alias("emd"), none.alias("emd_share")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("flagged", (F.col("jsd") > jsd) | (F.coalesce("emd_share", F.lit(0.0)) > emd))


def categorical_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return categorical_distances(a, b, [column]).select("jsd")


def continuous_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon distance over Freedman-Diaconis bins of the pooled values."""
    return continuous_distances(a, b, [column]).select("jsd")


def earth_movers(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Area between both distribution functions."""
    return earth_movers_distances(a, b, [column]).select("emd")


def correlated_columns(df: DataFrame, keys: list[str], target: str, columns: list[str]) -> DataFrame:
    """(keys, column_name, corr, place): Pearson correlation of a target with every column, all in one aggregate; place 1 has the greatest absolute value."""
    wide = df.groupBy(*keys).agg(*[F.corr(target, c).alias(c) for c in columns])
    long = wide.unpivot(keys, columns, "column_name", "corr")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.round(F.abs("corr"), 9)), "column_name"))  # a row per group and column
    return long.withColumn("place", place)


def joined_logs(logs: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """Logs of restarts in a row: each run is cut to its last epoch that has a loss, and its epochs go on from the last one of the runs before it; runs without a loss go."""
    ends = logs.where(F.col(loss).isNotNull()).groupBy(run).agg(F.max(epoch).alias("_last"))
    offset = F.sum("_last").over(Window.orderBy(run)) - F.col("_last")  # a row per run
    kept = logs.join(ends.withColumn("_offset", offset), run).where(F.col(epoch) <= F.col("_last"))
    return kept.withColumn("epoch_total", F.col(epoch) + F.col("_offset")).drop("_offset", "_last")

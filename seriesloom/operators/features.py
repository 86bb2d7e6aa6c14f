"""Statistical features of series: trend, autocorrelation, Fourier components, decomposition.

Sequence math is windows and grouped sums. Lags and frequencies are bounded,
so a series of n rows makes n times that many rows at most, and sums combine
before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import by_keys, quantiles_of, with_quantiles
from .scans import chunked, edges_of
from .windows import median_of, numbered


def statistical(long: DataFrame, keys: list[str]) -> DataFrame:
    one = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range"))
    one = with_quantiles(one, long, keys, "value", {"_a": 0.25, "_b": 0.75}).withColumn("iqr", F.col("_b") - F.col("_a")).drop("_a", "_b")
    return one.withColumn("cv", F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)))


def trend(df: DataFrame, keys: list[str], order: list[str], value: str, edge: int = 5, edges: tuple[int, list] | None = None) -> DataFrame:
    """Least-squares line against the position, and the change between the means of the first and last `edge` rows."""
    p = numbered(df, keys, order, total="_n", edges=edges)
    head, tail = F.avg(F.when(F.col("pos") < edge, F.col(value))), F.avg(F.when(F.col("pos") >= F.col("_n") - edge, F.col(value)))
    out = p.groupBy(*keys).agg(F.regr_slope(value, "pos").alias("slope"), F.regr_intercept(value, "pos").alias("intercept"), F.corr(value, "pos").alias("corr"), (tail - head).alias("edge_change"), (F.max_by(value, "pos") - F.min_by(value, "pos")).alias("change"))
    return out.withColumn("direction", F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat"))


def autocorrelation(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int, edges: tuple[int, list] | None = None) -> DataFrame:
    """Pearson correlation with itself at lags 1 .. lags, from one pass of running lags; undefined is 0."""
    c = chunked(df, keys, order, before=lags, edges=edges)
    back = c.own(c.rows.withColumn("_back", F.array(*[F.lag(value, k).over(c.window) for k in range(1, lags + 1)])))
    back = back.select(*keys, F.col(value).alias("_x"), F.posexplode_outer("_back").alias("_k", "_y"))
    return back.where("_y is not null").groupBy(*keys, (F.col("_k") + 1).alias("lag")).agg(F.coalesce(F.corr("_x", "_y"), F.lit(0.0)).alias("acf"))


def seasonality(acf: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """The highest peak of an autocorrelation table above `least`: its lag and strength."""
    w = Window.partitionBy(*keys).orderBy("lag")
    peak = (F.col("acf") > F.lag("acf").over(w)) & (F.col("acf") > F.lead("acf").over(w)) & (F.col("acf") > least)
    peaks = acf.withColumn("_p", peak).where("_p")
    best = peaks.groupBy(*keys).agg(F.max(F.struct("acf", (-F.col("lag")).alias("l"))).alias("_m"))
    return acf.select(*keys).distinct().join(best.select(*keys, (-F.col("_m.l")).alias("period"), F.col("_m.acf").alias("strength")), keys, "left")


def seasonal_variance(df: DataFrame, keys: list[str], order: list[str], value: str, edges: tuple[int, list] | None = None) -> DataFrame:
    """(keys, variance_ratio): variance of what a trailing mean over up to 4 rows (a quarter of the series, 2 at least) leaves, over the series' variance; 0 where it is undefined."""
    c = chunked(df, keys, order, before=3, edges=edges)
    mean = lambda n: F.when(F.col("_pos") >= n - 1, F.avg(value).over(c.window.rowsBetween(1 - n, 0)))
    trailing = F.when(F.col("_n") >= 16, mean(4)).when(F.col("_n") >= 12, mean(3)).when(F.col("_n") >= 8, mean(2))
    rest = c.own(c.rows.withColumn("_rest", F.col(value) - trailing))
    return rest.groupBy(*keys).agg(F.coalesce(F.try_divide(F.var_pop("_rest"), F.var_pop(value)), F.lit(0.0)).alias("variance_ratio"))


def seasonality_features(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int, least: float = 0.1, flag: float = 0.3, edges: tuple[int, list] | None = None) -> DataFrame:
    """(keys, period, strength, variance_ratio, has_seasonality): the highest autocorrelation peak of lags 1 .. lags (at most half the series), 0 without one."""
    edges = edges or edges_of(df, order[0])
    sizes = df.groupBy(*keys).agg(F.floor(F.count("*") / 2).alias("_half"))
    acf = by_keys(autocorrelation(df, keys, order, value, lags, edges), sizes, keys).where(F.col("lag") <= F.col("_half")).drop("_half")
    out = by_keys(seasonality(acf, keys, least), seasonal_variance(df, keys, order, value, edges), keys)
    out = out.withColumn("period", F.coalesce("period", F.lit(0))).withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    return out.withColumn("has_seasonality", F.when(F.col("strength") > flag, 1.0).otherwise(0.0))


def volatility_features(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, lags: int = 20, edges: tuple[int, list] | None = None) -> DataFrame:
    """Spread and shape of relative changes; mean and spread of the deviation of the `size` values before each row; and `clustering`, the mean autocorrelation of absolute changes at lags 1 .. lags.

    Series under 2 * size rows have no rolling deviation, those under 10 rows no clustering (0)."""
    edges = edges or edges_of(df, order[0])
    c = chunked(df, keys, order, before=max(size, 1), edges=edges)
    back = F.lag(value).over(c.window)
    rolled = F.when((F.col("_pos") >= size) & (F.col("_n") >= 2 * size), F.stddev_pop(value).over(c.window.rowsBetween(-size, -1)))
    r = c.own(c.rows.withColumns({"change": F.col(value) - back, "relative": F.try_divide(F.col(value) - back, back), "_v": rolled}))
    zero = lambda a: F.coalesce(a, F.lit(0.0))
    out = r.groupBy(*keys).agg(
        zero(F.stddev_pop("relative")).alias("std"), zero(F.skewness("relative")).alias("skew"), zero(F.kurtosis("relative")).alias("kurt"),
        zero(F.avg("_v")).alias("roll_mean"), zero(F.stddev_pop("_v")).alias("roll_std"), F.count("*").alias("_k"),
    )
    steps = r.drop("_v", "relative").where("change is not null").withColumn("_d", F.abs("change"))
    acf = by_keys(autocorrelation(steps, keys, order, "_d", lags, edges), out.select(*keys, "_k"), keys).where((F.col("lag") <= F.floor((F.col("_k") - 1) / 2)) & (F.col("_k") >= 10))
    return by_keys(out.drop("_k"), acf.groupBy(*keys).agg(F.avg("acf").alias("clustering")), keys, "left").withColumn("clustering", zero(F.col("clustering")))


def all_features(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, lags: int = 100, least: float = 0.1) -> DataFrame:
    """One record per series of its statistics, trend, seasonality and volatility."""
    edges = edges_of(df, order[0])
    parts = [
        statistical(df.select(*keys, F.col(value).alias("value")), keys), trend(df, keys, order, value, edges=edges), seasonality_features(df, keys, order, value, lags, least, edges=edges),
        volatility_features(df, keys, order, value, size, edges=edges).withColumnsRenamed({"std": "change_std", "skew": "change_skew", "kurt": "change_kurt"}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = by_keys(out, part, keys)
    return out


def outliers(df: DataFrame, keys: list[str], value: str, method: str, threshold: float) -> DataFrame:
    """Rows outside quartiles -+ threshold * IQR, or with |z| above it."""
    x, iqr = F.col(value), F.col("_b") - F.col("_a")
    if method == "iqr":
        stats, out = quantiles_of(df, keys, value, {"_a": 0.25, "_b": 0.75}), (x < F.col("_a") - threshold * iqr) | (x > F.col("_b") + threshold * iqr)
    else:
        stats, out = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")), F.abs(x - F.col("_m")) > threshold * F.col("_s")
    return by_keys(df, stats, keys).where(out).select(*df.columns)


def fourier(df: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """(keys, k, re, im, amplitude) of the standardized series for k = 1 .. most."""
    p = by_keys(numbered(df, keys, order, total="_n"), df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")), keys)
    p = p.withColumn("_z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    each = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(F.col("k") * 2 <= F.col("_n"))
    angle = F.col("k") * F.col("pos") * (2 * math.pi) / F.col("_n")
    sums = each.groupBy(*keys, "k").agg(F.sum(F.col("_z") * F.cos(angle)).alias("re"), F.sum(-F.col("_z") * F.sin(angle)).alias("im"), F.max("_n").alias("n"))
    return sums.withColumn("amplitude", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n"))


def reconstructed(df: DataFrame, components: DataFrame, keys: list[str], order: list[str], value: str, top: int) -> DataFrame:
    """The series from its `top` largest components, and the residual."""
    w = Window.partitionBy(*keys)
    best = components.withColumn("_r", F.row_number().over(w.orderBy(F.desc("amplitude"), "k"))).where(F.col("_r") <= top)
    packed = best.groupBy(*keys).agg(F.collect_list(F.struct("k", "re", "im", "n")).alias("_c"))
    p = by_keys(numbered(df, keys, order).join(packed, keys), df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")), keys)
    term = lambda a, c: a + 2 / c["n"] * (c["re"] * F.cos(c["k"] * F.col("pos") * (2 * math.pi) / c["n"]) - c["im"] * F.sin(c["k"] * F.col("pos") * (2 * math.pi) / c["n"]))
    out = p.withColumn("fitted", F.col("_m") + F.col("_s") * F.aggregate("_c", F.lit(0.0), term))
    return out.withColumn("residual", F.col(value) - F.col("fitted")).drop("_m", "_s", "_c")


#: Periods that are tried where a series has none of its own.
COMMON_PERIODS = [7, 12, 24, 30, 52, 365]


def spectrum(df: DataFrame, keys: list[str], order: list[str], value: str, most: int | None = None, edges: tuple[int, list] | None = None) -> DataFrame:
    """(keys, k, n, power) of the frequencies k / n below one half, or of the first `most` of them: a series of n rows makes n times as many rows, whose sums combine before the shuffle."""
    p = numbered(df, keys, order, total="n", edges=edges)
    last = F.floor((F.col("n") - 1) / 2) if most is None else F.least(F.lit(most), F.floor((F.col("n") - 1) / 2))
    each = p.where(F.col("n") > 2).withColumn("k", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    angle = F.pmod(F.col("k").cast("long") * F.col("pos"), F.col("n")) * (2 * math.pi) / F.col("n")
    sums = each.groupBy(*keys, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("_re"), F.sum(F.col(value) * F.sin(angle)).alias("_im"), F.max("n").alias("n"))
    return sums.select(*keys, "k", "n", (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("power"))


def dominant_periods(df: DataFrame, keys: list[str], order: list[str], value: str, low: int, high: int, n: int = 3, least: float = 0.1, most: int | None = None, edges: tuple[int, list] | None = None) -> DataFrame:
    """(keys, period, periods): the period of the strongest frequency, and up to `n` by power.

    A frequency counts if its power is above the mean by two deviations, its period (to the nearest whole number, halves to even) is
    between `low` and `high` and at most half the series, and the series correlates with itself by more than `least` at that lag. A series whose strongest frequency does not count
    takes the first common period in bounds, or `low`."""
    edges = edges or edges_of(df, order[0])
    w = Window.partitionBy(*keys)
    strong = spectrum(df, keys, order, value, most, edges).withColumn("_t", F.avg("power").over(w) + 2 * F.stddev_pop("power").over(w)).where("power > _t")
    strong = strong.withColumn("_r", F.row_number().over(w.orderBy(F.desc("power"), "k"))).withColumn("lag", F.bround(F.col("n") / F.col("k")).cast("int"))
    asked = strong.where(F.col("lag").between(low, high) & (F.col("lag") * 2 <= F.col("n")) & (F.col("_r") <= 2 * n))
    rows = numbered(df, keys, order, edges=edges).select(*keys, "pos", F.col(value).alias("_x"))
    ahead = by_keys(rows, asked.select(*keys, "lag").distinct(), keys).withColumn("_q", F.col("pos") + F.col("lag")).drop("pos")
    met = by_keys(ahead, rows.select(*keys, F.col("pos").alias("_q"), F.col("_x").alias("_y")), [*keys, "_q"]).groupBy(*keys, "lag").agg(F.corr("_x", "_y").alias("_acf"))
    good = by_keys(asked, met, [*keys, "lag"]).where(F.col("_acf") > least).groupBy(*keys, "lag").agg(F.min("_r").alias("_r"))
    found = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "lag"))).alias("_g"))  # 2 * n lags at most
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    common = F.coalesce(*[F.when((F.lit(p) >= low) & (F.lit(p) <= high) & (F.lit(p) <= F.floor(F.col("n") / 2)), F.lit(p)) for p in COMMON_PERIODS], F.lit(low))
    first = F.get("_g", F.lit(0))
    out = by_keys(sizes, found, keys, "left").withColumn("period", F.when(first["_r"] == 1, first["lag"]).otherwise(common))
    return out.select(*keys, "period", F.coalesce(F.slice(F.transform("_g", lambda g: g["lag"]), 1, n), F.array().cast("array<int>")).alias("periods"))


def window_fourier(arrays: DataFrame, column: str, n: int = 25) -> DataFrame:
    """Per window array: `coefficients`, the real parts of the first n Fourier coefficients over the length, plus 1, and 16 statistics of magnitudes, phases and values.

    Parts below 1e-9 count as 0, so that the phase of a coefficient without one is 0 or pi. A window with a null has null for all."""
    size = F.size(column)
    ks = F.sequence(F.lit(0), F.least(F.lit(n), size) - 1)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    part = lambda f, sign: lambda k: F.round(total(F.transform(column, lambda x, i: x * f(F.pmod(k * i, size) * (2 * math.pi) / size))) * sign / size, 9) + 0.0
    mean = lambda c: total(F.col(c)) / F.size(c)
    spread = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: F.pow(x - F.col(f"mean_{c.strip('_')}"), 2)), F.lit(0.0), lambda a, x: a + x) / F.size(c))
    out = arrays.withColumn("_re", F.transform(ks, part(F.cos, 1))).withColumn("_im", F.transform(ks, part(F.sin, -1)))
    out = out.withColumn("_magnitude", F.zip_with("_re", "_im", lambda a, b: F.sqrt(a * a + b * b))).withColumn("_phase", F.zip_with("_re", "_im", lambda a, b: F.atan2(b, a)))
    for c in ("_magnitude", "_phase"):
        name = c.strip("_")
        out = out.withColumn(f"mean_{name}", mean(c)).withColumn(f"median_{name}", median_of(F.col(c))).withColumn(f"std_{name}", spread(c))
    out = out.withColumn("ts_sum_values", total(F.col(column))).withColumn("ts_median", median_of(F.col(column))).withColumn("ts_mean", F.col("ts_sum_values") / size).withColumn("ts_length", size)
    out = out.withColumn("ts_var", F.aggregate(F.transform(column, lambda x: F.pow(x - F.col("ts_mean"), 2)), F.lit(0.0), lambda a, x: a + x) / size).withColumn("ts_std", F.sqrt("ts_var"))
    out = out.withColumn("ts_rms", F.sqrt(total(F.transform(column, lambda x: x * x)) / size)).withColumn("ts_max", F.array_max(column)).withColumn("ts_abs_max", F.array_max(F.transform(column, F.abs))).withColumn("ts_min", F.array_min(column))
    return out.withColumn("coefficients", F.transform("_re", lambda x: x + 1)).drop("_re", "_im", "_magnitude", "_phase")


def fixed_vector(df: DataFrame, keys: list[str], order: list[str], value: str, points: int, frequencies: int) -> DataFrame:
    """(keys, vector) of one length for all series: mean, deviation, least, greatest, median and quartiles, slope, autocorrelation at lags 1, 7 and 30, evenly spaced values,
    and magnitudes of evenly spaced frequencies of the half spectrum (all of them and zeros, if it has fewer). What is undefined is 0."""
    x = F.col(value).cast("double")
    c = chunked(df, keys, order, before=30)
    back = c.own(c.rows.withColumn("pos", F.col("_pos")).withColumn("n", F.col("_n")).withColumns({f"_l{k}": F.lag(x, k).over(c.window) for k in (1, 7, 30)}))
    one = back.groupBy(*keys).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.regr_slope(x, "pos").alias("slope"), *[F.corr(x, f"_l{k}").alias(f"a{k}") for k in (1, 7, 30)])
    one = with_quantiles(one, df, keys, value, {"q50": 0.5, "q25": 0.25, "q75": 0.75})
    size, width = F.floor(F.col("n") / 2) + 1, max(1, frequencies - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(frequencies - 1)), lambda i: F.when(size > frequencies, F.floor(i * (size - 1) / width)).when(i < size, i))
    each = back.select(*keys, "pos", "n", x.alias("_x"), F.posexplode(at).alias("i", "k")).where("k is not null")
    angle = F.pmod(F.col("k").cast("long") * F.col("pos"), F.col("n")) * (2 * math.pi) / F.col("n")
    sums = each.groupBy(*keys, "i").agg(F.sum(F.col("_x") * F.cos(angle)).alias("re"), F.sum(F.col("_x") * F.sin(angle)).alias("im"))
    packed = F.array_sort(F.collect_list(F.struct("i", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))))  # `frequencies` values a series
    out = by_keys(by_keys(one, sampled_points(df, keys, order, value, points).withColumnRenamed("vector", "_points"), keys), sums.groupBy(*keys).agg(packed.alias("_f")), keys)
    padded = F.transform(F.sequence(F.lit(0), F.lit(frequencies - 1)), lambda i: F.coalesce(F.get(F.col("_f"), i)["v"], F.lit(0.0)))
    names = ["m", "s", "lo", "hi", "q50", "q25", "q75", "slope", "a1", "a7", "a30"]
    whole = F.concat(F.array(*names), F.transform("_points", lambda v: v.cast("double")), padded)
    return out.select(*keys, F.transform(whole, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)).alias("vector"))


def decomposition(df: DataFrame, keys: list[str], order: list[str], value: str, period: int) -> DataFrame:
    """Classical decomposition: centred moving mean, mean of the detrended values by place in the period, rest."""
    c = chunked(df, keys, order, before=period // 2, after=period // 2)
    near = c.window.rowsBetween(-(period // 2), period // 2)
    p = c.own(c.rows.withColumn("pos", F.col("_pos")).withColumn("trend", F.avg(value).over(near)))
    place = p.withColumn("_p", F.col("pos") % period)
    means = place.groupBy(*keys, "_p").agg(F.avg(F.col(value) - F.col("trend")).alias("_raw"))
    means = means.withColumn("seasonal", F.col("_raw") - F.avg("_raw").over(Window.partitionBy(*keys))).drop("_raw")
    out = place.join(means, [*keys, "_p"]).drop("_p")
    return out.withColumn("rest", F.col(value) - F.col("trend") - F.col("seasonal"))


def strengths(parts: DataFrame, keys: list[str]) -> DataFrame:
    """How much of the variance trend and season explain, each against itself plus the rest."""
    one = lambda c: F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop("rest"), F.var_pop(F.col("rest") + F.col(c))))
    return parts.groupBy(*keys).agg(one("trend").alias("trend_strength"), one("seasonal").alias("seasonal_strength"))


def seasonal_forecast(parts: DataFrame, keys: list[str], period: int, horizon: int) -> DataFrame:
    """The last trend value plus the season's value for each future position."""
    last = parts.groupBy(*keys).agg(F.max("pos").alias("_last"), F.max_by("trend", "pos").alias("_trend"))
    season = parts.select(*keys, (F.col("pos") % period).alias("_p"), "seasonal").distinct()
    future = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_p", (F.col("_last") + F.col("step")) % period)
    return future.join(season, [*keys, "_p"]).select(*keys, "step", (F.col("_trend") + F.col("seasonal")).alias("forecast"))


def sampled_points(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """n values at evenly spaced positions, as an array; shorter series repeat positions."""
    placed = numbered(df, keys, order, "_pos", "_n")
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.floor(i * (F.col("_n") - 1) / (n - 1)).alias("at")))
    wanted = placed.select(*keys, value, F.explode(F.filter(at, lambda x: x["at"] == F.col("_pos"))).alias("_x"))
    packed = F.array_sort(F.collect_list(F.struct(F.col("_x.i").alias("i"), F.col(value).alias("v"))))  # n values a series
    return wanted.groupBy(*keys).agg(packed.alias("_r")).select(*keys, F.col("_r.v").alias("vector"))

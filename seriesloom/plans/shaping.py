"""Queries of cleaning, scaling, encoding, edits and series features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import edits as E
from ..operators import features as T
from ..operators import scaling as S
from ..operators.scans import edges_of
from .aggregating import L4, LONG, lines
from .base import query, table
from .windowing import ORDER, POS, WIN, event_windows

KEYS = ["event_type"]


def events(spark, sf):
    return table(spark, sf, "events")


def long_lines(spark, sf):
    from ..operators.aggregates import long_form

    return long_form(lines(spark, sf), L4, ("l_returnflag",)).withColumnRenamed("column", "column_name")


@query("cln1_clipped", "with s as (select avg(value) as m, stddev_pop(value) as s from events) select event_id, round(greatest(m - 1.5 * s, least(m + 1.5 * s, value)), 6) as value from events, s")
def cln1(spark, sf):
    return S.clipped(events(spark, sf), ["value"], 1.5).select("event_id", F.round("value", 6).alias("value"))


@query("cln2_last_of_duplicates", "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def cln2(spark, sf):
    return S.last_of_duplicates(events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("cln3_reject_duplicates", "select event_id, value from events")
def cln3(spark, sf):
    return S.reject_duplicates(events(spark, sf), ["event_id"]).select("event_id", "value")


@query("cln4_coerced", "select event_id, cast(json_extract_string(props, '$.k') as double) as k from events where event_id % 3 <> 0")
def cln4(spark, sf):
    k = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return S.coerced(events(spark, sf).withColumn("k", k), "k").select("event_id", "k")


_FIT = {"standard": ("avg(value)", "stddev_pop(value)"), "minmax": ("min(value)", "max(value) - min(value)"), "robust": ("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"), "none": ("0.0", "1.0")}


@query("scl1_fit_scalers", f"with {LONG} " + " union all ".join(f"select '{k}' as kind, column_name, l_returnflag, round({c}, 6) as centre, round(coalesce(nullif({s}, 0), 1), 6) as scale from lf group by all" for k, (c, s) in _FIT.items()))
def scl1(spark, sf):
    fitted = S.fit_scalers(long_lines(spark, sf), ["column_name", "l_returnflag"], list(_FIT))
    return fitted.select("kind", "column_name", "l_returnflag", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


_SCALED = "with s as (select user_id, avg(value) as c, coalesce(nullif(stddev_pop(value), 0), 1) as s from events where ts < timestamp '2024-01-20' group by 1)"


def _user_scaler(spark, sf):
    return S.fit_scaler(events(spark, sf).where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")), ["user_id"], "standard")


@query("scl2_apply_scaler", f"{_SCALED} select event_id, round((value - c) / s, 6) as value from events join s using (user_id)")
def scl2(spark, sf):
    known = events(spark, sf).join(_user_scaler(spark, sf).select("user_id"), "user_id", "left_semi")
    return S.apply_scaler(known, _user_scaler(spark, sf), ["user_id"]).select("event_id", F.round("value", 6).alias("value"))


@query("scl3_unscale", f"{_SCALED} select event_id, round(value, 5) as value from events join s using (user_id)")
def scl3(spark, sf):
    known = events(spark, sf).join(_user_scaler(spark, sf).select("user_id"), "user_id", "left_semi")
    scaled = S.apply_scaler(known, _user_scaler(spark, sf), ["user_id"])
    return S.apply_scaler(scaled, _user_scaler(spark, sf), ["user_id"], invert=True).select("event_id", F.round("value", 5).alias("value"))


@query("scl4_scaled_constraints", f"{_SCALED} select user_id, round((10 - c) / s, 6) as low, round((90 - c) / s, 6) as high from s")
def scl4(spark, sf):
    p = _user_scaler(spark, sf)
    limits = lambda v: S.apply_scaler(p.select("user_id", F.lit(v).alias("value")), p, ["user_id"]).select("user_id", F.round("value", 6).alias("low" if v < 50 else "high"))
    return limits(10.0).join(limits(90.0), "user_id")


@query("scl5_window_standardized", f"with {WIN} select event_type, window_idx, step, round(coalesce((value - avg(value) over (partition by event_type, window_idx)) / nullif(stddev_pop(value) over (partition by event_type, window_idx), 0), -9), 6) as z from w")
def scl5(spark, sf):
    w = event_windows(spark, sf)
    return w.select("event_type", "window_idx", "step", F.round(S.window_standardized(w, ["event_type", "window_idx"], "value", -9.0), 6).alias("z"))


@query("scl6_normalized_score", "select event_id, round(case when stddev_samp(value) over (partition by user_id) > 0 then (value - avg(value) over (partition by user_id)) / (stddev_samp(value) over (partition by user_id) + 1e-6) else value end, 5) as score from events")
def scl6(spark, sf):
    return events(spark, sf).select("event_id", F.round(S.normalized_score(["user_id"], "value"), 5).alias("score"))


@query("scl7_range_scaled", "select l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) over p) / (max(l_quantity) over p - min(l_quantity) over p), 6) as a, round((l_quantity * 1.1 - min(l_quantity) over p) / (max(l_quantity) over p - min(l_quantity) over p), 6) as f from lineitem window p as (partition by l_returnflag)")
def scl7(spark, sf):
    scaled = S.range_scaled(lines(spark, sf).withColumn("forecast", F.col("l_quantity") * 1.1), ["l_returnflag"], "l_quantity", a="l_quantity", f="forecast")
    return scaled.select("l_orderkey", "l_linenumber", F.round("a", 6).alias("a"), F.round("f", 6).alias("f"))


@query("enc1_one_hot", "select event_id, cast(event_type = 'click' as double) as event_type_click, cast(event_type = 'view' as double) as event_type_view, case when event_type in ('click', 'view') then event_type end as back from events")
def enc1(spark, sf):
    v = ["click", "view"]
    hot = S.one_hot(events(spark, sf), "event_type", v)
    return hot.select("event_id", *[f"event_type_{x}" for x in v], S.from_one_hot("event_type", v).alias("back"))


@query("enc2_codes_by_appearance", "with f as (select user_id, min(event_id) as f from events group by 1), c as (select user_id, row_number() over (order by f) - 1 as code from f) select event_id, code as user_id_code from events join c using (user_id)")
def enc2(spark, sf):
    return S.codes_by_appearance(events(spark, sf), "user_id", "event_id").select("event_id", F.col("user_id_code").cast("long").alias("user_id_code"))


@query("enc3_invariant_windows", f"with {WIN} select event_type, window_idx, arg_min(user_id, step) as user_id, count(distinct user_id) <= 1 as user_id_constant, count(distinct event_type) <= 1 as type_constant from w group by all")
def enc3(spark, sf):
    out = S.invariant_windows(event_windows(spark, sf), ["event_type", "window_idx"], ["user_id"])
    return out.withColumn("type_constant", F.lit(True))


@query("enc4_prepared_windows", f"""with {WIN}, s as (select event_type, window_idx, list(round(value / 100, 6) order by step) as v, case when min(pos) + {24} <= floor(any_value(n) * 0.8) then 'train' else 'test' end as split from w group by all) select * from s""")
def enc4(spark, sf):
    w = event_windows(spark, sf)
    n = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("step", rounded(F.col("value") / 100, 6).alias("v")))), lambda x: x["v"])
    out = w.groupBy("event_type", "window_idx").agg(packed.alias("v"), F.min("pos").alias("_p")).join(n, "event_type")
    return out.select("event_type", "window_idx", "v", F.when(F.col("_p") + 24 <= F.floor(F.col("n") * 0.8), "train").otherwise("test").alias("split"))


@query("edt1_perturbed", "select event_id, value + 5 as plus, value / 4 as quarter, cast('inf' as double) as over_zero from events")
def edt1(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", E.perturbed(e, "value", "add", 5).alias("plus"), E.perturbed(e, "value", "divide", 4).alias("quarter"), E.perturbed(e, "value", "divide", 0, over_zero=E.INFINITE).alias("over_zero"))


@query("edt2_exact", "select event_id, 7.5 as value, 'view' as event_type from events")
def edt2(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", E.exact(e, "value", 7.5).alias("value"), E.exact(e, "event_type", "view").alias("event_type"))


@query("edt3_ordered_edits", "select event_id, (value * 2) - case when ts between timestamp '2024-01-05' and timestamp '2024-01-08' then 3 else 0 end as value from events")
def edt3(spark, sf):
    edits = [{"column": "value", "how": "subtract", "value": 3, "start": "2024-01-05", "end": "2024-01-08", "order": 2}, {"column": "value", "how": "multiply", "value": 2, "order": 1}]
    return E.apply_edits(events(spark, sf), "ts", edits).select("event_id", "value")


@query("edt5_edit_grid", f"with {WIN}, c as (select unnest([0, 1, 2]) as combo, unnest([1.0, 1.5, 2.0]) as factor) select event_type, combo, combo * (select max(window_idx) + 1 from w) + window_idx as new_idx, round(sum(value * factor), 4) as total from w, c group by all")
def edt5(spark, sf):
    g = E.edit_grid(event_windows(spark, sf), [1.0, 1.5, 2.0], "value")
    return g.groupBy("event_type", F.col("combo").cast("long").alias("combo"), "new_idx").agg(F.round(F.sum("value"), 4).alias("total"))


@query("edt6_filter_combinations", "select distinct a.event_type, b.o_orderstatus from events a, (select distinct o_orderstatus from orders) b")
def edt6(spark, sf):
    a = events(spark, sf).select(F.lit("event_type").alias("column"), F.col("event_type").alias("value")).distinct()
    b = table(spark, sf, "orders").select(F.lit("o_orderstatus").alias("column"), F.col("o_orderstatus").alias("value")).distinct()
    return E.filter_combinations(a.unionByName(b))


@query("edt8_zeroed_tail", f"with {WIN}, a as (select event_type, window_idx, list(value order by step) as v from w group by all) select event_type, window_idx, list_concat(v[1:20], [0.0, 0.0, 0.0, 0.0]) as v from a")
def edt8(spark, sf):
    from ..operators.windows import window_arrays

    return window_arrays(event_windows(spark, sf), KEYS, ["value"]).select("event_type", "window_idx", E.zeroed_tail("value", 4).alias("v"))


@query("edt9_constrained", "with l as (select user_id, quantile_cont(value, 0.25) as low, quantile_cont(value, 0.75) as high from events group by 1) select event_id, round(least(high, greatest(low, value)), 6) as value from events join l using (user_id)")
def edt9(spark, sf):
    limits = events(spark, sf).groupBy("user_id").agg(F.percentile("value", F.lit(0.25)).alias("low"), F.percentile("value", F.lit(0.75)).alias("high"))
    return E.constrained(events(spark, sf), limits, ["user_id"], "value").select("event_id", F.round("value", 6).alias("value"))


@query("edt9_extreme_steps", f"with {WIN} select event_type, window_idx, (list(step order by value, step))[1] as argmin, (list(step order by value desc, step))[1] as argmax from w group by all")
def edt9b(spark, sf):
    return E.extreme_steps(event_windows(spark, sf), ["event_type", "window_idx"], "value", "step")


@query("edt10_filtered_edits", f"with {WIN}, ok as (select event_type, window_idx from w group by all having min(value) >= 1) select event_type, window_idx, step, value * 1.1 as value from w semi join ok using (event_type, window_idx)")
def edt10(spark, sf):
    from ..operators.filters import in_ranges, keep_windows

    kept = keep_windows(event_windows(spark, sf), in_ranges({"value": (1, 1e9)}), ["event_type", "window_idx"])
    return E.apply_edits(kept, "ts", [{"column": "value", "how": "multiply", "value": 1.1, "order": 1}]).select("event_type", "window_idx", "step", "value")


def _round(df, n, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, n) for c in columns})


@query("fea1_statistical", "select user_id, round(avg(value) + 1e-9, 5) as mean, round(stddev_pop(value) + 1e-9, 5) as std, round(max(value) - min(value) + 1e-9, 5) as range, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25) + 1e-9, 5) as iqr, round(coalesce(stddev_pop(value) / nullif(avg(value), 0), 0) + 1e-9, 5) as cv from events group by 1")
def fea1(spark, sf):
    return _round(T.statistical(events(spark, sf), ["user_id"]), 5, "mean", "std", "range", "iqr", "cv")


@query("fea2_trend", f"with {POS} select event_type, round(regr_slope(value, pos) + 1e-9, 6) as slope, round(regr_intercept(value, pos) + 1e-9, 4) as intercept, round(corr(value, pos) + 1e-9, 6) as corr, round(avg(value) filter (pos >= n - 5) - avg(value) filter (pos < 5) + 1e-9, 5) as edge_change, round(arg_max(value, pos) - arg_min(value, pos), 5) as change, case when regr_slope(value, pos) > 0 then 'up' else 'down' end as direction from p group by 1")
def fea2(spark, sf):
    return _round(_round(T.trend(events(spark, sf), KEYS, ORDER, "value"), 6, "slope", "corr"), 4, "intercept").withColumn("edge_change", F.round(F.col("edge_change") + 1e-9, 5)).withColumn("change", F.round("change", 5))


_ACF = f"{POS}, acf as (select a.event_type, k as lag, coalesce(corr(a.value, b.value), 0) as acf from p a, (select unnest(range(1, 25)) as k) join p b on b.event_type = a.event_type and b.pos = a.pos - k group by all)"


def acf(spark, sf):
    return T.autocorrelation(events(spark, sf), KEYS, ORDER, "value", 24)


_RATIO = f"vr as (select event_type, var_pop(case when pos >= 3 then value - m end) / var_pop(value) as variance_ratio from (select *, avg(value) over (partition by event_type order by pos rows 3 preceding) as m from p) group by 1)"
_SEASON = f"{_ACF}, q as (select *, acf > lag(acf) over o and acf > lead(acf) over o and acf > 0.01 as peak from acf window o as (partition by event_type order by lag)), t as (select distinct event_type from acf), {_RATIO}, sn as (select t.event_type, coalesce(arg_max(q.lag, q.acf), 0) as period, coalesce(max(q.acf), 0) as strength, any_value(variance_ratio) as variance_ratio from t join vr using (event_type) left join q on q.event_type = t.event_type and q.peak group by 1)"


@query("fea3_seasonality", f"with {_SEASON} select event_type, period, round(strength, 6) as strength, round(variance_ratio, 6) as variance_ratio, case when strength > 0.05 then 1.0 else 0.0 end as has_seasonality from sn")
def fea3(spark, sf):
    out = T.seasonality_features(events(spark, sf), KEYS, ORDER, "value", 24, 0.01, 0.05)
    return out.select("event_type", F.col("period").cast("long").alias("period"), F.round("strength", 6).alias("strength"), F.round("variance_ratio", 6).alias("variance_ratio"), "has_seasonality")


_VOL = """r as (select *, value - lag(value) over o as d, value / lag(value) over o - 1 as r, case when pos >= 10 then stddev_pop(value) over (partition by event_type order by pos rows between 10 preceding and 1 preceding) end as rv from p window o as (partition by event_type order by pos)),
rs as (select event_type, avg(r) as rm, stddev_pop(r) as std, avg(rv) as roll_mean, stddev_pop(rv) as roll_std from r group by 1),
sh as (select event_type, avg(pow((r - rm) / std, 3)) as skew, avg(pow((r - rm) / std, 4)) - 3 as kurt from r join rs using (event_type) group by 1),
cl as (select event_type, avg(c) as clustering from (select a.event_type, k, coalesce(corr(abs(a.d), abs(b.d)), 0) as c from r a, (select unnest(range(1, 21)) as k) join r b on b.event_type = a.event_type and b.pos = a.pos - k where b.d is not null group by all) group by 1),
vo as (select * from rs join sh using (event_type) join cl using (event_type))"""


@query("fea4_volatility", f"with {POS}, {_VOL} select event_type, round(std, 3) as std, round(skew, 4) as skew, round(kurt, 3) as kurt, round(roll_mean, 5) as roll_mean, round(roll_std, 5) as roll_std, round(clustering, 6) as clustering from vo")
def fea4(spark, sf):
    out = T.volatility_features(events(spark, sf), KEYS, ORDER, "value", 10)
    return out.select("event_type", *[F.round(c, n).alias(c) for c, n in (("std", 3), ("skew", 4), ("kurt", 3), ("roll_mean", 5), ("roll_std", 5), ("clustering", 6))])


@query("fea5_autocorrelation", f"with {_ACF} select event_type, lag, round(acf, 6) as acf from acf")
def fea5(spark, sf):
    return acf(spark, sf).select("event_type", F.col("lag").cast("long").alias("lag"), F.round("acf", 6).alias("acf"))


_RECORD = {"mean": 5, "std": 5, "range": 5, "iqr": 5, "cv": 5, "slope": 6, "intercept": 4, "corr": 6, "edge_change": 5, "change": 5, "strength": 6, "variance_ratio": 6, "roll_mean": 5, "roll_std": 5, "change_skew": 4, "clustering": 6}


@query("fea6_all_features", f"""with {_SEASON}, {_VOL}, bs as (select event_type, avg(value) as mean, stddev_pop(value) as std, max(value) - min(value) as range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr, coalesce(stddev_pop(value) / nullif(avg(value), 0), 0) as cv,
regr_slope(value, pos) as slope, regr_intercept(value, pos) as intercept, corr(value, pos) as corr, avg(value) filter (pos >= n - 5) - avg(value) filter (pos < 5) as edge_change, arg_max(value, pos) - arg_min(value, pos) as change from p group by 1),
al as (select bs.*, period, strength, variance_ratio, roll_mean, roll_std, skew as change_skew, clustering from bs join sn using (event_type) join vo using (event_type))
select event_type, period, """ + ", ".join(f"round({c} + 1e-9, {n}) as {c}" for c, n in _RECORD.items()) + " from al")
def fea6(spark, sf):
    out = T.all_features(events(spark, sf), KEYS, ORDER, "value", 10, 24, 0.01)
    return out.select("event_type", F.col("period").cast("long").alias("period"), *[F.round(F.col(c) + 1e-9, n).alias(c) for c, n in _RECORD.items()])


@query("fea7_outliers", "with s as (select event_type, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, avg(value) as m, stddev_pop(value) as s from events group by 1) select 'iqr' as method, event_id, value from events join s using (event_type) where value > b + 1.5 * (b - a) or value < a - 1.5 * (b - a) union all select 'z', event_id, value from events join s using (event_type) where abs(value - m) > 2 * s")
def fea7(spark, sf):
    pick = lambda m, t: T.outliers(events(spark, sf), KEYS, "value", m, t).select(F.lit(m).alias("method"), "event_id", "value")
    return pick("iqr", 1.5).unionByName(pick("z", 2.0))


_DFT = f"{POS}, z as (select *, (value - avg(value) over (partition by event_type)) / stddev_pop(value) over (partition by event_type) as z from p), dft as (select event_type, k, sum(z * cos(k * pos * {2 * math.pi!r} / n)) as re, sum(-z * sin(k * pos * {2 * math.pi!r} / n)) as im, max(n) as n from z, (select unnest(range(1, 13)) as k) where k * 2 <= n group by all), amp as (select *, sqrt(re * re + im * im) / n as amplitude from dft)"


def dft(spark, sf):
    return T.fourier(events(spark, sf), KEYS, ORDER, "value", 12)


@query("fea8_fourier", f"with {_DFT} select event_type, k, round(re, 4) as re, round(im, 4) as im, round(amplitude, 6) as amplitude from amp")
def fea8(spark, sf):
    return dft(spark, sf).select("event_type", F.col("k").cast("long").alias("k"), F.round("re", 4).alias("re"), F.round("im", 4).alias("im"), F.round("amplitude", 6).alias("amplitude"))


@query("fea8_reconstructed", f"with {_DFT}, b as (select * from amp qualify row_number() over (partition by event_type order by amplitude desc, k) <= 3), f as (select p.event_type, event_id, value, avg(value) over (partition by p.event_type) as m, stddev_pop(value) over (partition by p.event_type) as s, (select sum(2.0 / b.n * (re * cos(k * pos * {2 * math.pi!r} / b.n) - im * sin(k * pos * {2 * math.pi!r} / b.n))) from b where b.event_type = p.event_type) as t from p) select event_id, round(m + s * t, 4) as fitted from f")
def fea8r(spark, sf):
    return T.reconstructed(events(spark, sf), dft(spark, sf), KEYS, ORDER, "value", 3).select("event_id", F.round("fitted", 4).alias("fitted"))


_WF = ["mean_magnitude", "median_magnitude", "std_magnitude", "mean_phase", "median_phase", "std_phase", "ts_sum_values", "ts_median", "ts_mean", "ts_std", "ts_var", "ts_rms", "ts_max", "ts_abs_max", "ts_min"]


@query("fea9_window_fourier", f"""with {WIN}, co as (select event_type, window_idx, k, round(sum(value * cos(((k * step) % 24) * {2 * math.pi!r} / 24)) / 24, 9) + 0.0 as re, round(-sum(value * sin(((k * step) % 24) * {2 * math.pi!r} / 24)) / 24, 9) + 0.0 as im from w, (select unnest(range(0, 24)) as k) group by all),
m as (select event_type, window_idx, list(round(re + 1 + 2.3e-10, 5) order by k) as coefficients, avg(sqrt(re * re + im * im)) as mean_magnitude, median(sqrt(re * re + im * im)) as median_magnitude, stddev_pop(sqrt(re * re + im * im)) as std_magnitude, avg(atan2(im, re)) as mean_phase, median(atan2(im, re)) as median_phase, stddev_pop(atan2(im, re)) as std_phase from co group by all),
v as (select event_type, window_idx, sum(value) as ts_sum_values, median(value) as ts_median, avg(value) as ts_mean, count(*) as ts_length, stddev_pop(value) as ts_std, var_pop(value) as ts_var, sqrt(avg(value * value)) as ts_rms, max(value) as ts_max, max(abs(value)) as ts_abs_max, min(value) as ts_min from w group by all)
select event_type, window_idx, coefficients, ts_length, {", ".join(f"round({c} + 1e-7, 5) as {c}" for c in _WF)} from m join v using (event_type, window_idx)""")
def fea9(spark, sf):
    from ..operators.windows import window_arrays

    out = T.window_fourier(window_arrays(event_windows(spark, sf), KEYS, ["value"]), "value")
    return out.select("event_type", "window_idx", F.transform("coefficients", lambda x: rounded(x + 2.3e-10, 5)).alias("coefficients"), F.col("ts_length").cast("long").alias("ts_length"), *[F.round(F.col(c) + 1e-7, 5).alias(c) for c in _WF])


@query("fea10_dominant_period", f"""with p as (select user_id, value + 60 * cos((row_number() over (partition by user_id order by ts, event_id) - 1) * {2 * math.pi!r} / 8) as v, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events),
s as (select user_id, k, n, pow(sum(v * cos(((k * pos) % n) * {2 * math.pi!r} / n)), 2) + pow(sum(v * sin(((k * pos) % n) * {2 * math.pi!r} / n)), 2) as power from p, (select unnest(range(1, 400)) as k) where k <= (n - 1) // 2 group by all),
g as (select *, row_number() over (partition by user_id order by power desc, k) as r, cast(round_even(n / k, 0) as bigint) as lag from s qualify power > avg(power) over (partition by user_id) + 2 * stddev_pop(power) over (partition by user_id)),
a as (select g.user_id, g.lag, min(g.r) as r from g where lag between 3 and 30 and lag * 2 <= n and r <= 6 group by all),
c as (select a.user_id, a.lag, a.r from a join p x on x.user_id = a.user_id join p y on y.user_id = a.user_id and y.pos = x.pos + a.lag group by all having corr(x.v, y.v) > 0.1),
f as (select user_id, list(lag order by r)[:3] as periods, min(r) as first from c group by 1), z as (select user_id, any_value(n) as n from p group by 1)
select z.user_id, cast(case when first = 1 then periods[1] when n // 2 >= 7 then 7 else 3 end as integer) as period, list_transform(coalesce(periods, []), lambda x: cast(x as integer)) as periods from z left join f using (user_id)""")
def fea10(spark, sf):
    edges = edges_of(events(spark, sf), ORDER[0])
    placed = T.numbered(events(spark, sf), ["user_id"], ORDER, edges=edges)
    wave = placed.withColumn("v", F.col("value") + 60 * F.cos(F.col("pos") * (2 * math.pi) / 8)).drop("pos")
    return T.dominant_periods(wave, ["user_id"], ORDER, "v", 3, 30, edges=edges)


_DEC = f"{POS}, t as (select *, avg(value) over (partition by event_type order by pos rows between 12 preceding and 12 following) as trend from p), m as (select event_type, pos % 24 as ph, avg(value - trend) as raw from t group by all), s as (select event_type, ph, raw - avg(raw) over (partition by event_type) as seasonal from m), parts as (select t.*, seasonal, value - trend - seasonal as rest from t join s on s.event_type = t.event_type and s.ph = pos % 24)"


def parts(spark, sf):
    return T.decomposition(events(spark, sf), KEYS, ORDER, "value", 24)


@query("fea11_decomposition", f"with {_DEC} select event_id, round(trend + 1e-9, 5) as trend, round(seasonal, 5) as seasonal, round(rest, 5) as rest from parts")
def fea11(spark, sf):
    return parts(spark, sf).select("event_id", F.round(F.col("trend") + 1e-9, 5).alias("trend"), F.round("seasonal", 5).alias("seasonal"), F.round("rest", 5).alias("rest"))


@query("fea11_strengths", f"with {_DEC} select event_type, round(greatest(0, 1 - var_pop(rest) / var_pop(rest + trend)), 6) as trend_strength, round(greatest(0, 1 - var_pop(rest) / var_pop(rest + seasonal)), 6) as seasonal_strength from parts group by 1")
def fea11s(spark, sf):
    return T.strengths(parts(spark, sf), KEYS).select("event_type", F.round("trend_strength", 6).alias("trend_strength"), F.round("seasonal_strength", 6).alias("seasonal_strength"))


@query("fea12_seasonal_forecast", f"with {_DEC}, l as (select event_type, max(pos) as last, arg_max(trend, pos) as trend from parts group by 1) select l.event_type, k as step, round(l.trend + s.seasonal, 5) as forecast from l, (select unnest(range(1, 13)) as k) join s on s.event_type = l.event_type and s.ph = (last + k) % 24")
def fea12(spark, sf):
    return T.seasonal_forecast(parts(spark, sf), KEYS, 24, 12).select("event_type", F.col("step").cast("long").alias("step"), F.round("forecast", 5).alias("forecast"))


@query("fea13_sampled_points", f"with {POS}, k as (select unnest(range(0, 8)) as i) select event_type, list(value order by i) as vector from p join k on pos = cast(floor(i * (n - 1) / 7) as bigint) group by 1")
def fea13(spark, sf):
    return T.sampled_points(events(spark, sf), KEYS, ["ts", "event_id"], "value", 8)


@query("fea13_fixed_vector", f"""with p as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events),
b as (select *, lag(value, 1) over o as l1, lag(value, 7) over o as l7, lag(value, 30) over o as l30 from p window o as (partition by user_id order by pos)),
st as (select user_id, [avg(value), stddev_pop(value), min(value), max(value), median(value), quantile_cont(value, 0.25), quantile_cont(value, 0.75), regr_slope(value, pos), corr(value, l1), corr(value, l7), corr(value, l30)] as s from b group by 1),
pt as (select user_id, list(value order by i) as pts from p join (select unnest(range(0, 8)) as i) on pos = cast(floor(i * (n - 1) / 7) as bigint) group by 1),
fq as (select user_id, n, i, case when n // 2 + 1 > 6 then cast(floor(i * (n // 2) / 5) as bigint) when i < n // 2 + 1 then i end as k from (select user_id, any_value(n) as n from p group by 1), (select unnest(range(0, 6)) as i)),
fr as (select q.user_id, i, coalesce(sqrt(pow(sum(value * cos(((k * pos) % q.n) * {2 * math.pi!r} / q.n)), 2) + pow(sum(value * sin(((k * pos) % q.n) * {2 * math.pi!r} / q.n)), 2)), 0) as m from fq q left join p on p.user_id = q.user_id and k is not null group by all),
fl as (select user_id, list(m order by i) as f from fr group by 1)
select user_id, list_transform(list_concat(s, pts, f), lambda x: case when x is null or isnan(x) or isinf(x) then 0 else round(x + 1e-7, 4) end) as vector from st join pt using (user_id) join fl using (user_id)""")
def fea13v(spark, sf):
    return T.fixed_vector(events(spark, sf), ["user_id"], ORDER, "value", 8, 6).withColumn("vector", F.transform("vector", lambda x: rounded(x + 1e-7, 4)))


@query("fea14_cut_by_date", "select event_id from events where ts < timestamp '2024-01-12'")
def fea14(spark, sf):
    return events(spark, sf).where(F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")).select("event_id")

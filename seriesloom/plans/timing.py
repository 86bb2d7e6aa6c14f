"""Queries of calendars, frequencies, sampling and splitting."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import grid as G
from ..operators import sampling as S
from .base import query, table
from .joining import _CAL, calendar
from .windowing import WIN, event_windows


def events(spark, sf):
    return table(spark, sf, "events")


def orders(spark, sf):
    return table(spark, sf, "orders")


@query("grd1_regrid", "with s as (select event_type, date_trunc('hour', ts) as ts, avg(value) as v from events group by all), e as (select event_type, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from s group by 1) select e.event_type, e.ts, round(v + 1e-9, 5) as value from e left join s using (event_type, ts)")
def grd1(spark, sf):
    return G.regrid(events(spark, sf), ["event_type"], "ts", "value", "hour").withColumn("value", F.round(F.col("value") + 1e-9, 5))


@query("grd2_spine", "select user_id, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), interval 1 day)) as day from events group by 1")
def grd2(spark, sf):
    return G.spine(events(spark, sf).withColumn("day", G.truncated("day", "ts")), ["user_id"], "day", "interval 1 day")


def _grain(level):
    start = f"date_trunc('{level}', ts)" + (" + interval 3 month" if level == "quarter" else "")
    return f"select '{level}' as grain, {start} as ts, round(avg(v) + 1e-9, 4) as v from o group by all"


@query("grd3_downsample", "with o as (select o_orderdate as ts, o_totalprice as v from orders) " + " union all ".join(map(_grain, G.LEVELS[1:])))
def grd3(spark, sf):
    o = orders(spark, sf).select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    out = None
    for level in G.LEVELS[1:]:
        one = G.downsample(o, [], "ts", "v", level).select(F.lit(level).alias("grain"), "ts", F.round(F.col("v") + 1e-9, 4).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


_LEVELS = ["year", "quarter", "month", "week", "day"]
_AT = {"year": "ts + to_months(cast(3 * k as integer))", "quarter": "ts + to_months(cast(k as integer))", "month": "ts + to_days(cast(7 * k as integer))", "week": "ts + to_days(cast(k as integer))", "day": "ts + to_hours(cast(k as integer))"}
_TIMES = {"year": "4", "quarter": "3", "month": "cast(ceil(day(last_day(ts)) / 7.0) as bigint)", "week": "7", "day": "24"}


@query("grd4_upsample", "with " + ", ".join(f"{x} as (select date_trunc('{x}', o_orderdate) as ts, count(*) as n from orders group by 1)" for x in _LEVELS) + " " + " union all ".join(f"select '{x}' as level, {_AT[x]} as ts, n from (select *, unnest(range(0, {_TIMES[x]})) as k from {x})" for x in _LEVELS))
def grd4(spark, sf):
    counts = lambda level: orders(spark, sf).groupBy(G.truncated(level, "o_orderdate").alias("ts")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [G.upsample(counts(x), "ts", x).select(F.lit(x).alias("level"), "ts", "n") for x in _LEVELS])


_UP = {"week": "day", "month": "week", "quarter": "month", "year": "quarter"}


@query("grd5_all_levels", "with day as (select o_orderpriority as k, date_trunc('day', o_orderdate) as ts, avg(o_totalprice) as v from orders group by all), " + ", ".join(f"{x} as (select k, {'date_trunc(' + chr(39) + x + chr(39) + ', ts)' + (' + interval 3 months' if x == 'quarter' else '')} as ts, avg(v) as v from \"{y}\" group by all)" if x != "month" else f"month as (select k, date_trunc('month', ts) as ts, avg(v) as v from week group by all)" for x, y in _UP.items()) + ", u as (" + " union all ".join(f"select '{x}' as level, * from \"{x}\"" for x in ["day", *_UP]) + "), c as (select level, k from u group by level, k qualify row_number() over (partition by level order by count(*) desc, k) <= 2) select level, k, ts, round(v + 1e-8, 5) as v from u join c using (level, k)")
def grd5a(spark, sf):
    daily_ = orders(spark, sf).groupBy(F.col("o_orderpriority").alias("k"), G.truncated("day", "o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("v"))
    return G.longest(G.all_levels(daily_, ["k"], "ts", "v", "day", "year"), "level", ["k"], 2).withColumn("v", F.round(F.col("v") + 1e-8, 5))


@query("grd5_resample_levels", "with d as (select date_trunc('day', o_orderdate) as ts, avg(o_totalprice) as v from orders group by 1), w as (select date_trunc('week', ts) as ts, avg(v) as v from d group by 1), m as (select date_trunc('month', ts) as ts, avg(v) as v from w group by 1) select ts, round(v + 1e-9, 3) as v from m")
def grd5(spark, sf):
    hourly = orders(spark, sf).select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    return G.resample_to(hourly, [], "ts", "v", "hour", "month").withColumn("v", F.round(F.col("v") + 1e-9, 3))


@query("grd6_rounded", "select event_id, date_trunc('hour', ts + interval 30 minute) as hour, case when dayofmonth(ts) >= 16 then date_trunc('month', ts) + interval 1 month else date_trunc('month', ts) end as month, date_trunc('year', ts + interval 6 month) as year, date_trunc('quarter', ts) as quarter from events")
def grd6(spark, sf):
    return events(spark, sf).select("event_id", *[G.rounded(u, "ts").cast("timestamp_ntz").alias(u) for u in ("hour", "month", "year", "quarter")])


@query("grd7_resample", "select event_type, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as slot, round(sum(value), 4) as total, round(quantile_cont(value, 0.5), 4) as middle, arg_min(value, ts) as first, arg_max(value, ts) as last from events group by all")
def grd7(spark, sf):
    out = G.resample(events(spark, sf), ["event_type"], "ts", 6 * 3600, {"total": ("value", "sum"), "middle": ("value", "median"), "first": ("value", "first"), "last": ("value", "last")})
    return out.withColumns({"total": F.round("total", 4), "middle": F.round("middle", 4)})


@query("grd7_resample_filled", """with s as (select user_id, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as slot, avg(value) as mean, arg_max(event_type, ts) as kind from events group by all),
e as (select user_id, min(slot) as a, max(slot) as b from s group by 1), g as (select user_id, unnest(generate_series(a, b, interval 6 hour)) as slot from e), j as (select g.user_id, g.slot, mean, kind, row_number() over (partition by g.user_id order by g.slot) as pos from g left join s on s.user_id = g.user_id and s.slot = g.slot),
k as (select *, max(case when mean is not null then pos end) over (partition by user_id order by pos) as a, min(case when mean is not null then pos end) over (partition by user_id order by pos rows between current row and unbounded following) as b from j)
select k.user_id, k.slot, round(x.mean + (y.mean - x.mean) * coalesce((k.pos - k.a) / nullif(k.b - k.a, 0), 0) + 1e-7, 5) as mean, k.kind from k join j x on x.user_id = k.user_id and x.pos = k.a join j y on y.user_id = k.user_id and y.pos = k.b""")
def grd7f(spark, sf):
    out = G.resample_filled(events(spark, sf), ["user_id"], "ts", 6 * 3600, {"mean": ("value", "mean")}, {"kind": ("event_type", "last")})
    return out.select("user_id", "slot", F.round(F.col("mean") + 1e-7, 5).alias("mean"), "kind")


@query("grd8_weekly_first", "select user_id, date_trunc('week', ts) as week, arg_min(value, ts) as first from events group by all")
def grd8(spark, sf):
    return events(spark, sf).groupBy("user_id", G.truncated("week", "ts").alias("week")).agg(F.min_by("value", "ts").alias("first"))


@query("grd9_padded", """with g as (select user_id, ts, value, date_diff('microsecond', lag(ts) over (partition by user_id order by ts), ts) // 1000000 as gap from events), s as (select user_id, count(*) as n, min(ts) as lo, cast(floor(quantile_cont(gap, 0.5)) as bigint) as step from g group by 1 having count(*) < 50 and count(*) > 1)
select user_id, count(*) as rows, min(ts) as first, count(value) as known from (select user_id, ts, value from events union all select user_id, lo - to_seconds(step * k), null from s, unnest(range(1, 50 - n + 1)) as t(k)) group by 1""")
def grd9(spark, sf):
    p = G.padded(events(spark, sf), ["user_id"], "ts", "value", 50)
    return p.groupBy("user_id").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.count("value").alias("known"))


_PARTS = "p as (select *, coalesce((year(ts) - lo) / nullif(hi - lo, 0) - 0.5, 0) as y from (select *, year(o_orderdate) as yy, o_orderdate as ts, min(year(o_orderdate)) over (partition by o_orderstatus) as lo, max(year(o_orderdate)) over (partition by o_orderstatus) as hi from orders))"


@query("tim1_scaled_parts", f"with {_PARTS} select o_orderkey, round(y, 6) as y, round((month(ts) - 6) / 12, 6) as m, round((dayofmonth(ts) - 15.5) / 31, 6) as d, round((hour(ts) - 12) / 24, 6) as h from p")
def tim1(spark, sf):
    p = C.scaled_parts(orders(spark, sf), ["o_orderstatus"], "o_orderdate")
    return p.select("o_orderkey", *[F.round(f"time_{k.upper()}", 6).alias(k) for k in "ymdh"])


_VECTOR = {"year": "(year(ts) - 1970) / 60", "quarter": "(quarter(ts) - 1) / 3", "month": "(month(ts) - 1) / 11", "week": "(weekofyear(ts) - 1) / 52", "day": "(day(ts) - 1) / 30", "weekday": "(isodow(ts) - 1) / 6", "hour": "hour(ts) / 23", "minute": "minute(ts) / 59", "second": "second(ts) / 59", "zone": "(user_id % 5 - 2 + 12) / 26"}


@query("tim2_calendar_vector", f"with {_CAL} select event_id, " + ", ".join(f"round({e}, 6) as {c}" for c, e in _VECTOR.items()) + ", cast(ts as date) in (select holiday from cal) as is_holiday from events")
def tim2(spark, sf):
    v = C.calendar_vector(events(spark, sf), "ts", calendar(spark, sf), F.col("user_id") % 5 - 2)
    return v.select("event_id", *[F.round(c, 6).alias(c) for c in _VECTOR], "is_holiday")


@query("tim3_unscaled_parts", "select o_orderkey, date_trunc('second', o_orderdate) as ts from orders")
def tim3(spark, sf):
    p = C.scaled_parts(orders(spark, sf), ["o_orderstatus"], "o_orderdate")
    ends = orders(spark, sf).groupBy("o_orderstatus").agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    return p.join(ends, "o_orderstatus").select("o_orderkey", C.unscaled_parts(F.col("lo"), F.col("hi")).alias("ts"))


_GAPS = "g as (select user_id, date_diff('microsecond', lag(ts) over (partition by user_id order by ts), ts) // 1000000 as gap from (select distinct user_id, ts from events) qualify gap is not null)"
_MODE = "m as (select user_id, gap from (select user_id, gap, count(*) as n from g group by all) qualify row_number() over (partition by user_id order by n desc, gap) = 1)"


@query("tim4_frequency", f"with {_GAPS}, {_MODE} select user_id, gap, case when gap <= 59 then 'second' when gap <= 3599 then 'minute' when gap <= 86399 then 'hour' when gap <= 518400 then 'day' when gap <= 2332800 then 'week' when gap <= 7603200 then 'month' when gap <= 31104000 then 'quarter' else 'year' end as unit from m")
def tim4(spark, sf):
    return C.frequency(events(spark, sf), ["user_id"], "ts")


@query("tim5_row_step", "with d as (select distinct o_orderstatus, date_trunc('month', o_orderdate) as ts from orders) select o_orderstatus, '1 month' as step from d group by 1")
def tim5(spark, sf):
    m = orders(spark, sf).select("o_orderstatus", G.truncated("month", "o_orderdate").alias("ts"))
    return C.row_step(m, ["o_orderstatus"], "ts").select("o_orderstatus", "step")


@query("tim6_interval_summary", f"with {_GAPS}, {_MODE} select e.user_id, min(ts) as first, max(ts) as last, (select min(gap) from g where g.user_id = e.user_id) as smallest, (select max(gap) from g where g.user_id = e.user_id) as largest, (select gap from m where m.user_id = e.user_id) as modal from events e group by 1")
def tim6(spark, sf):
    return C.interval_summary(events(spark, sf), ["user_id"], "ts")


@query("tim7_timestamp_range", "select min(ts) as first, max(ts) as last from events")
def tim7(spark, sf):
    return C.timestamp_range(events(spark, sf), "ts")


@query("tim8_future_timestamps", "select user_id, k as step, date_trunc('hour', max(ts)) + to_hours(cast(k * 6 as integer)) as future from events, (select unnest(range(1, 5)) as k) group by user_id, k")
def tim8(spark, sf):
    last = events(spark, sf).groupBy("user_id").agg(G.truncated("hour", F.max("ts")).alias("last"))
    return C.future_timestamps(last, "last", 4, "interval 6 hours").select("user_id", F.col("step").cast("long").alias("step"), "future")


@query("tim9_forecast_frame", "select event_id, case when ts <= timestamp '2024-01-20' then 'history' else 'truth' end as part from events where ts between timestamp '2024-01-10' and timestamp '2024-01-25'")
def tim9(spark, sf):
    return C.forecast_frame(events(spark, sf), ["event_type"], "ts", "2024-01-10", "2024-01-20", "2024-01-25").select("event_id", "part")


@query("tim10_zones", "select event_id, ts + interval 9 hour as tokyo, ts - interval 5 hour as bogota from events")
def tim10(spark, sf):
    to = lambda zone: F.convert_timezone(F.lit("UTC"), F.lit(zone), "ts")
    return events(spark, sf).select("event_id", to("Asia/Tokyo").alias("tokyo"), to("America/Bogota").alias("bogota"))


@query("tim11_coded_start", "select o_orderkey, cast(epoch(date_trunc('month', o_orderdate)) as bigint) as monthly, cast(epoch(date_trunc('quarter', o_orderdate)) as bigint) as quarterly, cast(epoch(date_trunc('year', o_orderdate)) as bigint) as yearly from orders")
def tim11(spark, sf):
    o = orders(spark, sf).select("o_orderkey", F.date_format("o_orderdate", "yyMM").alias("a"), F.concat(F.date_format("o_orderdate", "yy"), F.quarter("o_orderdate")).alias("b"), F.date_format("o_orderdate", "yyyy").alias("c"), *[F.lit(f).alias(f) for f in ("monthly", "quarterly", "yearly")])
    return o.select("o_orderkey", *[C.coded_start(x, f).cast("long").alias(f) for x, f in (("a", "monthly"), ("b", "quarterly"), ("c", "yearly"))])


@query("tim12_date_chunks", "with e as (select user_id, cast(min(ts) as date) as a, cast(max(ts) as date) as b from events group by 1), c as (select user_id, b, cast(unnest(generate_series(a, b, interval 7 day)) as date) as s from e) select user_id, cast(s as varchar) as chunk_start, cast(least(s + 6, b) as varchar) as chunk_end from c")
def tim12(spark, sf):
    e = events(spark, sf).groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return C.date_chunks(e, "a", "b", 7).select("user_id", F.col("chunk_start").cast("string").alias("chunk_start"), F.col("chunk_end").cast("string").alias("chunk_end"))


@query("tim13_decimal_hours", "select event_id, round(hour(ts) + minute(ts) / 60, 6) as hours from events")
def tim13(spark, sf):
    return events(spark, sf).select("event_id", F.date_format("ts", "HH:mm").alias("t")).select("event_id", F.round(C.decimal_hours("t"), 6).alias("hours"))


@query("tim14_cyclic_features", f"select event_id, round(sin(hour(ts) * {2 * math.pi / 24!r}), 6) as hour_sin, round(cos((isodow(ts) - 1) * {2 * math.pi / 7!r}), 6) as weekday_cos, round(sin(dayofyear(ts) * {2 * math.pi / 366!r}), 6) as yearday_sin, row_number() over (partition by event_type order by ts) - 1 as index from events")
def tim14(spark, sf):
    f = C.cyclic_features(events(spark, sf), ["event_type"], "ts")
    return f.select("event_id", *[F.round(c, 6).alias(c) for c in ("hour_sin", "weekday_cos", "yearday_sin")], F.col("index").cast("long").alias("index"))


KW = ["event_type", "window_idx"]


@query("top1_ordered_windows", f"with {WIN}, e as (select event_type, window_idx, max(value) as m, min(ts) as t from w group by all order by m desc, t, event_type, window_idx limit 5) select event_type, window_idx, event_id from w semi join e using (event_type, window_idx)")
def top1(spark, sf):
    return S.ordered_windows(event_windows(spark, sf), KW, [("value", False), ("ts", True)], 5).select(*KW, "event_id")


@query("top2_top_per_group", "select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as place from events where value >= 50 qualify place <= 3")
def top2(spark, sf):
    return S.top_per_group(events(spark, sf).where("value >= 50"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("top3_best_and_worst", f"with {WIN}, e as (select event_type, window_idx, round(avg(abs(value - 40)) / (max(value) - min(value)), 9) as err from w group by all) select event_type, window_idx, case when row_number() over (partition by event_type order by err, window_idx) <= 2 then 'best' else 'worst' end as kind from e qualify row_number() over (partition by event_type order by err, window_idx) <= 2 or row_number() over (partition by event_type order by err desc, window_idx) <= 2")
def top3(spark, sf):
    err = event_windows(spark, sf).groupBy(*KW).agg(F.round(F.avg(F.abs(F.col("value") - 40)) / (F.max("value") - F.min("value")), 9).alias("err"))
    best = S.top_per_group(err, ["event_type"], [F.col("err"), F.col("window_idx")], 2).select(*KW, F.lit("best").alias("kind"))
    worst = S.top_per_group(err, ["event_type"], [F.desc("err"), F.col("window_idx")], 2).select(*KW, F.lit("worst").alias("kind"))
    return best.unionByName(worst.join(best, KW, "left_anti"))


@query("top5_first_rows", "select event_id, ts from events order by ts, event_id limit 25")
def top5(spark, sf):
    return events(spark, sf).orderBy("ts", "event_id").limit(25).select("event_id", "ts")


@query("top6_first_rows_filled", "select user_id, event_id, coalesce(case when event_id % 7 > 1 then value end, 0) as y from events qualify row_number() over (partition by user_id order by ts, event_id) <= 6")
def top6(spark, sf):
    g = events(spark, sf).withColumn("y", F.when(F.col("event_id") % 7 > 1, F.col("value")))
    return S.first_rows_filled(g, ["user_id"], ["ts", "event_id"], 6, "y").select("user_id", "event_id", "y")


@query("top7_second_half", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts, event_id) > count(*) over (partition by user_id) // 2")
def top7(spark, sf):
    return S.half(events(spark, sf), ["user_id"], ["ts", "event_id"], True).select("user_id", "event_id")


def _draw(columns, seed=0):
    return f"(cast('0x' || substring(md5('{seed}|' || {columns}), 1, 13) as bigint) / {float(1 << 52)!r})"


@query("smp1_share", f"select event_id from events where {_draw('event_id')} < 0.2")
def smp1(spark, sf):
    return S.share(events(spark, sf), ["event_id"], 20).select("event_id")


@query("smp2_series_split", f"select user_id, case when {_draw('user_id', 3)} < 0.3 then 'blind' else 'pretrain' end as part, count(*) as n from events group by all")
def smp2(spark, sf):
    return S.series_split(events(spark, sf), "user_id", 30, 3).groupBy("user_id", "part").agg(F.count("*").alias("n"))


_DEAL = f"n as (select user_id, count(*) as length from events group by 1), d as (select user_id, length, r, {_draw(chr(34) + 'user_id' + chr(34) + chr(124) * 2 + chr(39) + chr(124) + chr(39) + chr(124) * 2 + 'r')} as h from n, (select unnest(range(0, 2)) as r)), b as (select *, cast(floor(h * 16) as bigint) as bucket from d), s as (select *, (row_number() over (partition by r, bucket order by h, user_id) - 1) // 3 as set from b)"


@query("smp3_enrichment_sets", f"with {_DEAL} select r as round, bucket, set, user_id, row_number() over (partition by r, bucket, set order by length desc, user_id) = 1 as leads from s")
def smp3(spark, sf):
    n = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("length"))
    return S.enrichment_sets(n, "user_id", "length", 3, 2).withColumn("round", F.col("round").cast("long"))


@query("smp5_noise", f"select event_id, round(case when {_draw('event_id', 3)} < 0.5 then value + (2 * greatest({_draw('event_id', 1)}, 1e-12) - 1) * 0.1 * (select stddev_pop(value) from events) else value end, 5) as value_noisy from events")
def smp5(spark, sf):
    return S.noised(events(spark, sf), "value", ["event_id"], "uniform", 0.1, 0.5, True).select("event_id", F.round("value_noisy", 5).alias("value_noisy"))


@query("smp6_thinned", f"with c as (select *, (row_number() over (partition by event_type order by event_id) - 1) // 10 as chunk from events) select event_type, chunk, event_id from c qualify row_number() over (partition by event_type, chunk order by {_draw('event_id', 4)}) = 1")
def smp6(spark, sf):
    return S.thinned(events(spark, sf), ["event_type"], ["event_id"], 10).select("event_type", "chunk", "event_id")


@query("smp7_every_kth", "select user_id, event_id from events qualify (row_number() over (partition by user_id order by ts, event_id) - 1) % 5 = 0")
def smp7(spark, sf):
    return G.every_kth(events(spark, sf), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("smp8_sampled_batches", f"with b as (select user_id from (select distinct user_id from events) order by {_draw('user_id')}, user_id limit 12) select event_id from events where user_id in (select user_id from b)")
def smp8(spark, sf):
    return S.sampled_batches(events(spark, sf), "user_id", 12).select("event_id")


@query("set1_union", "select c_custkey as key, 'customer' as source from customer union all select s_suppkey, 'supplier' from supplier")
def set1(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("source"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("source")))


@query("set2_id_sets", "select 'both' as kind, user_id from (select user_id from events where event_type = 'error' intersect select user_id from events where value > 200) union all select 'less', user_id from (select user_id from events where event_type = 'error' except select user_id from events where value > 200)")
def set2(spark, sf):
    a, b = events(spark, sf).where("event_type = 'error'").select("user_id"), events(spark, sf).where("value > 200").select("user_id")
    return a.intersect(b).select(F.lit("both").alias("kind"), "user_id").unionByName(a.subtract(b).select(F.lit("less").alias("kind"), "user_id"))


@query("set3_shared_timestamps", "select count(*) as n from (select distinct date_trunc('hour', ts) as h from events where event_type = 'click') semi join (select date_trunc('hour', ts) as h from events where event_type = 'purchase') using (h)")
def set3(spark, sf):
    hours = lambda t: events(spark, sf).where(F.col("event_type") == t).select(G.truncated("hour", "ts").alias("h")).distinct()
    return hours("click").join(hours("purchase"), "h").agg(F.count("*").alias("n"))


@query("set4_union_of_categories", "select coalesce(a.c, b.c) as c, coalesce(a.n, 0) as a, coalesce(b.n, 0) as b from (select p_type as c, count(*) as n from part where p_size < 10 group by 1) a full join (select p_type as c, count(*) as n from part where p_size >= 40 group by 1) b on a.c = b.c")
def set4(spark, sf):
    count = lambda cond, n: table(spark, sf, "part").where(cond).groupBy(F.col("p_type").alias("c")).agg(F.count("*").alias(n))
    return count("p_size < 10", "a").join(count("p_size >= 40", "b"), "c", "full").fillna(0, ["a", "b"])


_ZONES = "c as (select user_id, count(*) as n from events group by 1), z as (select user_id, n, case when n = 12 then n else cast(floor(n * 0.7e0) as bigint) end as a, greatest(case when n = 12 then n else cast(floor(n * 0.7e0) as bigint) end, cast(floor(n * (0.7e0 + 0.2e0)) as bigint)) as b from c), s as (select user_id, 'train' as split, 0 as lo, a as hi from z where a >= 12 union all select user_id, 'val', a, b from z where a >= 12 union all select user_id, 'test', b, n from z where a >= 12), k as (select *, (hi - lo - 12) // 6 as k from s where hi - lo >= 12), ws as (select user_id, split, hi - 12 - k * 6 + i * 6 as start from k, unnest(range(0, k + 1)) as t(i))"


@query("spl1_window_splits", f"with {_ZONES} select * from ws")
def spl1(spark, sf):
    c = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return S.window_splits(c, ["user_id"], "n", 12, 6, 0.7, 0.2)


@query("spl2_partitioned_splits", """with c as (select user_id, count(*) as n from events group by 1), p as (select user_id, part, least(26, n - part * 26) as n from (select *, unnest(range(0, (n - 1) // 26 + 1)) as part from c)),
a as (select *, case when n = 4 then n else n * 16 // 26 end as a from p), b as (select *, greatest(a, n * 22 // 26) as b from a where a >= 4),
z as (select user_id, part, 'train' as split, 0 as lo, a as hi from b union all select user_id, part, 'val', a, b from b union all select user_id, part, 'test', b, n from b)
select user_id, part, split, part * 26 + hi - 4 - i * 2 as start from (select *, unnest(range(0, (hi - lo - 4) // 2 + 1)) as i from z where hi - lo >= 4)""")
def spl2(spark, sf):
    """Shares of 0.7, 0.2 and 0.1 with windows of 4 rows, 2 apart: parts of 16 + 6 + 4 rows."""
    c = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return S.partitioned_splits(c, ["user_id"], "n", 4, 2, 0.7, 0.2).select("user_id", F.col("part").cast("long").alias("part"), "split", "start")


@query("spl3_without_overlaps", "with c as (select user_id, count(*) as n from events group by 1), w as (select user_id, i * 4 as start, case when i % 9 = 8 then 'test' when i % 9 = 5 then 'val' else 'train' end as split from c, unnest(range(0, n // 4)) as t(i)), v as (select * from w a where split = 'val' and not exists (select 1 from w b where b.user_id = a.user_id and b.split = 'test' and abs(a.start - b.start) < 12)) select user_id, start, split from w where split = 'test' union all select user_id, start, split from v union all select user_id, start, split from w a where split = 'train' and not exists (select 1 from w b where b.user_id = a.user_id and b.split = 'test' and abs(a.start - b.start) < 12) and not exists (select 1 from v b where b.user_id = a.user_id and abs(a.start - b.start) < 12)")
def spl3(spark, sf):
    c = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 4")
    w = c.select("user_id", F.explode(F.expr("sequence(0L, n div 4 - 1)")).alias("i")).selectExpr("user_id", "i * 4 as start", "case when i % 9 = 8 then 'test' when i % 9 = 5 then 'val' else 'train' end as split")
    return S.drop_overlaps(w, ["user_id"], 12)


@query("spl4_own_split", "select o_orderkey, case o_orderstatus when 'O' then 'train' when 'F' then 'val' else 'test' end as split from orders")
def spl4(spark, sf):
    own = F.when(F.col("o_orderstatus") == "O", " Train").when(F.col("o_orderstatus") == "F", "VAL").otherwise("test ")
    return S.own_split(orders(spark, sf).withColumn("given", own), "given").select("o_orderkey", "split")


@query("spl5_hash_ratio_split", f"with p as (select user_id, event_id, row_number() over (partition by user_id order by {_draw('event_id')}, event_id) as p, count(*) over (partition by user_id) as n from events) select event_id, case when p <= floor(n * 0.6e0) then 'train' when p <= floor(n * (0.6e0 + 0.2e0)) then 'val' else 'test' end as split from p")
def spl5(spark, sf):
    return S.hash_ratio_split(events(spark, sf), ["user_id"], ["event_id"], 0.6, 0.2).select("event_id", "split")


@query("spl6_time_split", "select event_id, case when ts < timestamp '2024-01-20' then 'train' when ts < timestamp '2024-01-25' then 'val' else 'test' end as split from events")
def spl6(spark, sf):
    return S.time_split(events(spark, sf), "ts", "2024-01-20", "2024-01-25").select("event_id", "split")


@query("spl7_cut_then_ratio", f"select event_id, case when ts <= timestamp '2024-01-20' then 'train' when {_draw('event_id', 5)} < 0.4 then 'val' else 'test' end as split from events")
def spl7(spark, sf):
    return S.cut_then_ratio(events(spark, sf), "ts", "2024-01-20", ["event_id"], 0.4).select("event_id", "split")


@query("spl8_mixed_splits", f"with u as (select 'a' as source, event_id as id from events union all select 'b', o_orderkey from orders) select source, id, case when {_draw(chr(34) + 'source' + chr(34) + chr(124) * 2 + chr(39) + chr(124) + chr(39) + chr(124) * 2 + 'id')} < 0.8 then 'train' else 'test' end as split from u")
def spl8(spark, sf):
    u = events(spark, sf).select(F.lit("a").alias("source"), F.col("event_id").alias("id")).unionByName(orders(spark, sf).select(F.lit("b").alias("source"), F.col("o_orderkey").alias("id")))
    return u.withColumn("split", F.when(S.draw("source", "id") < 0.8, "train").otherwise("test"))


@query("spl9_chronological_split", "with p as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as p, count(*) over (partition by user_id) as n from events) select event_id, case when p <= floor(n * 0.8e0) then 'train' when p <= floor(n * (0.8e0 + 0.1e0)) then 'val' else 'test' end as split from p")
def spl9(spark, sf):
    return S.chronological_split(events(spark, sf), ["user_id"], ["ts", "event_id"], 0.8, 0.1).select("event_id", "split")


@query("spl10_entity_split", f"select l_suppkey, l_partkey, case when {_draw(chr(34) + 'l_suppkey' + chr(34) + chr(124) * 2 + chr(39) + chr(124) + chr(39) + chr(124) * 2 + 'l_partkey', 7)} < 0.7 then 'train' else 'test' end as split from (select distinct l_suppkey, l_partkey from lineitem)")
def spl10(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return pairs.withColumn("split", F.when(S.draw("l_suppkey", "l_partkey", seed=7) < 0.7, "train").otherwise("test"))


@query("spl11_rolling_origins", "with o as (select unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-25', interval 5 day)) as origin) select event_type, origin, count(*) filter (ts <= origin) as history, count(*) filter (ts > origin and ts <= origin + interval 3 day) as target from events, o group by all")
def spl11(spark, sf):
    r = S.rolling_origins(events(spark, sf), ["event_type"], "ts", "2024-01-10", "2024-01-25", "interval 5 days", "interval 3 days")
    return r.groupBy("event_type", "origin").agg(F.count_if(F.col("part") == "history").alias("history"), F.count_if(F.col("part") == "target").alias("target"))


@query("spl12_forecast_windows", "with e as (select user_id, date_trunc('day', min(ts)) as a, date_trunc('day', max(ts)) as b from events group by 1) select distinct user_id, origin from (select user_id, unnest(generate_series(a, b, interval 4 day)) as origin from e union all select user_id, b from e)")
def spl12(spark, sf):
    e = events(spark, sf).groupBy("user_id").agg(G.truncated("day", F.min("ts")).alias("a"), G.truncated("day", F.max("ts")).alias("b"))
    return S.forecast_windows(e, "a", "b", 4).select("user_id", "origin")


@query("spl13_validation_cut", f"with {WIN}, a as (select event_type, window_idx, list(value order by step) as v from w group by all) select event_type, window_idx, v[1:12] as history, v[13:18] as target from a")
def spl13(spark, sf):
    from ..operators.windows import window_arrays

    a = window_arrays(event_windows(spark, sf), ["event_type"], ["value"]).select(*KW, F.slice("value", 1, 18).alias("history"))
    return a.select(*KW, F.slice("history", 1, 12).alias("history"), F.slice("history", -6, 6).alias("target"))


@query("spl14_split_labels", f"with {_ZONES} select split, user_id, count(*) as windows, min(start) as first from ws group by all")
def spl14(spark, sf):
    return spl1(spark, sf).groupBy("split", "user_id").agg(F.count("*").alias("windows"), F.min("start").alias("first"))

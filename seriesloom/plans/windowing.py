"""Queries of windows, lags, rolling statistics and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .base import query, table

KEYS, ORDER = ["event_type"], ["ts", "event_id"]
SIZE, STRIDE = 24, 12
#: The event series by type, and its sliding windows, in SQL.
POS = "p as (select *, row_number() over (partition by event_type order by ts, event_id) - 1 as pos, count(*) over (partition by event_type) as n from events)"
WIN = f"{POS}, w as (select *, pos - window_idx * {STRIDE} as step from (select *, unnest(range(greatest(0, cast(ceil((pos - {SIZE - 1}) / {STRIDE}) as bigint)), least(pos // {STRIDE}, (n - {SIZE}) // {STRIDE}) + 1)) as window_idx from p where n >= {SIZE}))"
GAPS = "g as (select *, case when event_id % 7 in (0, 1) then null else value end as y from events)"
OVER = "partition by event_type order by ts, event_id"


def events(spark, sf):
    return table(spark, sf, "events")


def gappy(spark, sf):
    return events(spark, sf).withColumn("y", F.when(~(F.col("event_id") % 7).isin(0, 1), F.col("value")))


def event_windows(spark, sf):
    return W.sliding_windows(events(spark, sf).select("event_type", "event_id", "ts", "value", "user_id"), KEYS, ORDER, SIZE, STRIDE)


@query("win1_sliding_windows", f"with {WIN} select event_type, window_idx, list(event_id order by step) as ids, round(list_sum(list(value order by step)), 4) as total from w group by all")
def win1(spark, sf):
    arrays = W.window_arrays(event_windows(spark, sf), KEYS, ["event_id", "value"])
    return arrays.select("event_type", "window_idx", F.col("event_id").alias("ids"), F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("win2_standardized_windows", f"with {WIN} select event_type, window_idx, step, round((value - avg(value) over v) / coalesce(nullif(stddev_samp(value) over v, 0), 1), 6) as scaled from w window v as (partition by event_type, window_idx)")
def win2(spark, sf):
    return W.standardized_windows(event_windows(spark, sf), KEYS, "value").select("event_type", "window_idx", "step", F.round("scaled", 6).alias("scaled"))


@query("win3_history_target", f"""with {WIN}, a as (select event_type, window_idx, list(case when event_id % 97 = 0 then null else value end order by step) as v, min(ts) as start_ts from w group by all)
select event_type, window_idx, v[1:18] as history, v[19:24] as target, start_ts from a where len(list_filter(v, lambda x: x is null)) = 0""")
def win3(spark, sf):
    w = event_windows(spark, sf).withColumn("value", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    packed = F.array_sort(F.collect_list(F.struct("step", "value")))
    arrays = w.groupBy("event_type", "window_idx").agg(packed.alias("r"), F.min("ts").alias("start_ts")).withColumn("v", F.col("r.value"))
    return W.history_and_target(arrays, "v", 18, 6).select("event_type", "window_idx", "history", "target", "start_ts")


@query("win4_blocks", f"with {POS}, b as (select *, pos // 32 as block from p), f as (select *, count(*) over (partition by event_type, block) as k from b) select event_type, event_id, block, case when pos % 32 < 28 then 'history' else 'target' end as part from f where k = 32")
def win4(spark, sf):
    return W.blocks(events(spark, sf), KEYS, ORDER, 32, 28).select("event_type", "event_id", F.col("block").cast("long").alias("block"), "part")


@query("win5_lag_or_zero", f"select event_type, event_id, case when row_number() over ({OVER}) <= 5 then 0.0 else lag(value, 5) over ({OVER}) end as value_lag_5 from events")
def win5(spark, sf):
    return W.lag_or_zero(events(spark, sf), KEYS, ORDER, "value", 5).select("event_type", "event_id", "value_lag_5")


@query("win6_many_lags", f"""with l as (select event_type, event_id, ts, lag(value, 1) over ({OVER}) as a, lag(value, 7) over ({OVER}) as b from events)
select event_type, event_id, coalesce(last_value(a ignore nulls) over ({OVER} rows between unbounded preceding and current row), first_value(a ignore nulls) over ({OVER} rows between current row and unbounded following), 0) as value_lag_1,
coalesce(last_value(b ignore nulls) over ({OVER} rows between unbounded preceding and current row), first_value(b ignore nulls) over ({OVER} rows between current row and unbounded following), 0) as value_lag_7 from l""")
def win6(spark, sf):
    return W.many_lags(events(spark, sf), KEYS, ORDER, "value", [1, 7]).select("event_type", "event_id", "value_lag_1", "value_lag_7")


def decayed(rows: str, alpha: float, terms: int, where: str = "true") -> str:
    """SQL of sums of decaying weights over the rows that have a value: k, kk (squared weights), kx and kxx of `rows` (event_type, event_id, pos, x)."""
    w = f"pow({1 - alpha!r}, d)"
    return f"""select a.event_type, a.event_id, sum({w}) filter (b.x is not null) as k, sum({w} * {w}) filter (b.x is not null) as kk, sum({w} * b.x) as kx, sum({w} * b.x * b.x) as kxx
  from {rows} a cross join (select unnest(range(0, {terms})) as d) join {rows} b on a.event_type = b.event_type and b.pos = a.pos - d where {where} group by all"""


_DEV = "case when k * k - kk > 1e-12 * k * k then sqrt(greatest(kxx / k - pow(kx / k, 2), 0) * k * k / (k * k - kk)) end"


@query("win7_ema", f"""with {GAPS}, p as (select *, y as x, row_number() over ({OVER}) - 1 as pos from g), j as ({decayed("p", 2 / 6, 96)})
select p.event_type, p.event_id, round(kx / k, 4) as y_ema, round({_DEV}, 3) as y_ema_std from p left join j using (event_type, event_id)""")
def win7(spark, sf):
    return W.ema(gappy(spark, sf), KEYS, ORDER, "y", 5).select("event_type", "event_id", F.round("y_ema", 4).alias("y_ema"), F.round("y_ema_std", 3).alias("y_ema_std"))


@query("win7_recursive_ema", f"""with recursive {GAPS}, p as (select *, row_number() over (partition by user_id order by ts, event_id) as pos from g), r as (
  select user_id, event_id, pos, y as e, 1 as gap from p where pos = 1
  union all
  select p.user_id, p.event_id, p.pos, case when p.y is null then r.e when r.e is null then p.y else (pow({1 - 2 / 6!r}, r.gap) * r.e + {2 / 6!r} * p.y) / (pow({1 - 2 / 6!r}, r.gap) + {2 / 6!r}) end,
    case when p.y is null then r.gap + 1 else 1 end
  from r join p on p.user_id = r.user_id and p.pos = r.pos + 1)
select user_id, event_id, round(e, 4) as y_ema from r""")
def win7r(spark, sf):
    return W.ema(gappy(spark, sf), ["user_id"], ORDER, "y", 5, adjust=False).select("user_id", "event_id", F.round("y_ema", 4).alias("y_ema"))


@query("win8_rolling_mean", f"select event_type, event_id, round(avg(value) over ({OVER} rows between 6 preceding and current row), 5) as value_mean_7 from events")
def win8(spark, sf):
    return W.rolling_mean(events(spark, sf), KEYS, ORDER, "value", 7).select("event_type", "event_id", F.round("value_mean_7", 5).alias("value_mean_7"))


@query("win8_mean_in_time", f"with {GAPS} select event_type, event_id, round(avg(y) over (partition by event_type order by ts range between interval 21599999999 microseconds preceding and current row), 5) as y_mean from g")
def win8t(spark, sf):
    return W.rolling_mean_in_time(gappy(spark, sf), KEYS, "ts", "y", 21600).select("event_type", "event_id", F.round("y_mean", 5).alias("y_mean"))


@query("win9_gaussian_smooth", f"""with {GAPS}, p as (select *, row_number() over ({OVER}) - 1 as pos, count(*) over (partition by event_type) as n,
  coalesce(last_value(y ignore nulls) over ({OVER} rows between unbounded preceding and current row), first_value(y ignore nulls) over ({OVER} rows between current row and unbounded following)) as x from g),
k as (select d, exp(-0.5 * pow(d / 2.0, 2)) as g from (select unnest(range(-8, 9)) as d)),
m as (select p.event_type, p.event_id, p.y, p.n, g, ((pos + d) % (2 * n) + 2 * n) % (2 * n) as spot from p cross join k)
select m.event_type, m.event_id, case when any_value(m.y) is not null then round(sum(g * b.x) / sum(g), 5) end as y_smooth
from m join p b on b.event_type = m.event_type and b.pos = case when spot < m.n then spot else 2 * m.n - 1 - spot end group by all""")
def win9(spark, sf):
    return W.gaussian_smooth(gappy(spark, sf), KEYS, ORDER, "y", 2.0).select("event_type", "event_id", F.round("y_smooth", 5).alias("y_smooth"))


_NEAR, _FAR = f"({OVER} rows between 11 preceding and current row)", f"({OVER} rows between 47 preceding and current row)"
VOLATILE = f"""p0 as (select *, value as x, row_number() over ({OVER}) - 1 as pos from events), ew as ({decayed("p0", 2 / 13, 180)}),
m as (select *, count(value) over {_NEAR} as k, stddev_samp(value) over {_NEAR} as s, list(value) over {_NEAR} as l, median(value) over {_NEAR} as md from events),
v as (select m.* exclude (k, s, l, md), case when m.k = 12 then s end as roll_std, case when m.k = 12 then list_median(list_transform(l, lambda t: abs(t - md))) end as roll_mad, {_DEV.replace("k * k - kk > 1e-12 * k * k", "ew.k * ew.k - kk > 1e-12 * ew.k * ew.k").replace("kxx / k", "kxx / ew.k").replace("kx / k", "kx / ew.k").replace("* k * k / (k * k - kk)", "* ew.k * ew.k / (ew.k * ew.k - kk)")} as ewm_std from m join ew using (event_type, event_id)),
bs as (select *, case when count(roll_std) over {_FAR} = 48 then avg(roll_std) over {_FAR} end as b1, case when count(roll_mad) over {_FAR} = 48 then avg(roll_mad) over {_FAR} end as b2, case when count(ewm_std) over {_FAR} = 48 then avg(ewm_std) over {_FAR} end as b3 from v),
x as (select *, list_avg(list_filter([(roll_std - b1) / nullif(b1, 0), (roll_mad - b2) / nullif(b2, 0), (ewm_std - b3) / nullif(b3, 0)], lambda t: t is not null)) as score from bs)"""


@query("win10_volatility", f"with {VOLATILE} select event_type, event_id, round(roll_std, 4) as roll_std, round(roll_mad, 3) as roll_mad, round(ewm_std, 4) as ewm_std, round(score, 5) as score from x")
def win10(spark, sf):
    out = W.volatility(events(spark, sf), KEYS, ORDER, "value", 12, 48)
    return out.select("event_type", "event_id", *[F.round(c, n).alias(c) for c, n in (("roll_std", 4), ("roll_mad", 3), ("ewm_std", 4), ("score", 5))])


PATTERN = """l as (select *, list_filter([lag(value, 24) over o, lag(value, 48) over o, lag(value, 72) over o, lag(value, 96) over o], lambda x: x is not null) as b,
  avg(value) over (partition by event_type, hour(ts)) as hm, stddev_samp(value) over (partition by event_type, hour(ts)) as hs, avg(value) over (partition by event_type, dayofweek(ts)) as wm, stddev_samp(value) over (partition by event_type, dayofweek(ts)) as ws
  from events window o as (partition by event_type order by ts)),
sc as (select *, case when len(b) > 1 then abs(value - list_avg(b)) / (list_stddev_samp(b) + 1e-6) end as slot_score, abs(value - hm) / (hs + 1e-6) as hour_score, abs(value - wm) / (ws + 1e-6) as weekday_score from l),
pt as (select *, list_avg(list_filter([slot_score, hour_score, weekday_score], lambda x: x is not null)) as pattern_score from sc)"""


@query("win11_slot_score", f"with {PATTERN} select event_type, event_id, round(slot_score, 4) as slot_score, round(hour_score, 4) as hour_score, round(weekday_score, 4) as weekday_score, round(pattern_score, 4) as pattern_score from pt")
def win11(spark, sf):
    out = W.pattern_score(events(spark, sf), KEYS, "ts", "value", 24)
    return out.select("event_type", "event_id", *[F.round(c, 4).alias(c) for c in ("slot_score", "hour_score", "weekday_score", "pattern_score")])


@query("win12_long_term_score", f"select event_type, event_id, round(abs(value - avg(value) over (w rows between 12 preceding and 1 preceding)) / (stddev_samp(value) over (w rows between 12 preceding and 1 preceding) + 1e-6), 3) as long_score from events window w as ({OVER})".replace("(w rows", f"({OVER} rows").replace(f" window w as ({OVER})", ""))
def win12(spark, sf):
    return W.long_term_score(events(spark, sf), KEYS, ORDER, "value").select("event_type", "event_id", F.round("long_score", 3).alias("long_score"))


@query("win13_segments", """with b as (select *, case when ts < lag(ts) over (partition by user_id order by value, event_id) then 1 else 0 end as k from events),
s as (select *, sum(k) over (partition by user_id order by value, event_id rows unbounded preceding) as segment from b), c as (select *, count(*) over (partition by user_id, segment) as n from s)
select user_id, event_id, cast(segment as bigint) as segment from c where n >= 4""")
def win13(spark, sf):
    return W.segments(events(spark, sf), ["user_id"], ["value", "event_id"], "ts", 4).select("user_id", "event_id", "segment")


@query("win14_large_groups", "select event_id, user_id from events where user_id in (select user_id from events group by 1 having count(*) >= 20)")
def win14(spark, sf):
    return W.large_groups(events(spark, sf), ["user_id"], 20).select("event_id", "user_id")


@query("win15_relative_changes", f"select event_type, event_id, round(value - lag(value) over ({OVER}), 6) as change, round((value - lag(value) over ({OVER})) / nullif(lag(value) over ({OVER}), 0), 6) as relative from events")
def win15(spark, sf):
    return W.relative_changes(events(spark, sf), KEYS, ORDER, "value").select("event_type", "event_id", F.round("change", 6).alias("change"), F.round("relative", 6).alias("relative"))


@query("fil1_fill_both_ways", f"with {GAPS} select event_type, event_id, coalesce(last_value(y ignore nulls) over ({OVER} rows between unbounded preceding and current row), first_value(y ignore nulls) over ({OVER} rows between current row and unbounded following), 0) as filled from g")
def fil1(spark, sf):
    return W.filled_both_ways(gappy(spark, sf), KEYS, ORDER, {"filled": "y"}, 0.0).select("event_type", "event_id", "filled")


@query("fil2_interpolate", f"""with {GAPS}, p as (select *, row_number() over ({OVER}) as pos from g), k as (select *, case when y is not null then pos end as q from p),
e as (select *, last_value(q ignore nulls) over ({OVER} rows between unbounded preceding and current row) as a, first_value(q ignore nulls) over ({OVER} rows between current row and unbounded following) as b,
last_value(y ignore nulls) over ({OVER} rows between unbounded preceding and current row) as av, first_value(y ignore nulls) over ({OVER} rows between current row and unbounded following) as bv from k)
select event_type, event_id, round(coalesce(y, av + (bv - av) * (pos - a) / nullif(b - a, 0), av, bv, 0), 6) as y_filled from e""")
def fil2(spark, sf):
    return W.interpolate(gappy(spark, sf), KEYS, ORDER, "y").select("event_type", "event_id", F.round("y_filled", 6).alias("y_filled"))


@query("fil3_fill_mean", f"with {GAPS} select user_id, event_id, round(coalesce(y, avg(y) over (partition by user_id), 0) + 1e-9, 5) as y_filled from g")
def fil3(spark, sf):
    return W.fill_mean(gappy(spark, sf), ["user_id"], "y").select("user_id", "event_id", F.round(F.col("y_filled") + 1e-9, 5).alias("y_filled"))


@query("fil4_trim", f"with {GAPS}, e as (select user_id, min(ts) as lo, max(ts) as hi from g where y is not null group by 1) select g.user_id, g.event_id from g join e on g.user_id = e.user_id and g.ts between lo and hi")
def fil4(spark, sf):
    return W.trim(gappy(spark, sf), ["user_id"], "ts", "y").select("user_id", "event_id")


@query("fil5_last_rows", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 8")
def fil5(spark, sf):
    return W.last_rows(events(spark, sf), ["user_id"], ORDER, 8).select("user_id", "event_id")

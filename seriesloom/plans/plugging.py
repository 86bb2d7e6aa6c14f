"""Queries of user steps: a feature chain, grouped functions, a forecaster of the user's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plugging as P
from .base import query, table

CUT = "2024-01-25"


def events(spark, sf):
    return table(spark, sf, "events")


@query("fn_feature_chain", "select event_id, case when row_number() over w <= 3 then 0.0 else lag(value, 3) over w end as value_lag_3, cast(hour(ts) as bigint) as hour, cast(isodow(ts) - 1 as bigint) as weekday from events window w as (partition by event_type order by ts, event_id)")
def chain(spark, sf):
    steps = [P.lag_step(["event_type"], ["ts", "event_id"], "value", 3), P.calendar_step("ts")]
    out = P.feature_chain(events(spark, sf), steps)
    return out.select("event_id", "value_lag_3", F.col("hour").cast("long").alias("hour"), F.col("weekday").cast("long").alias("weekday"))


@query("fn_group_functions", "select user_id, count(*) as n, max(value) - min(value) as spread, count(*) filter (value > 50) as above from events group by 1")
def grouped(spark, sf):
    functions = {"n": F.count, "spread": F.max("value") - F.min("value"), "above": lambda c: F.count_if(F.col(c) > 50)}
    return P.by_group(events(spark, sf), ["user_id"], functions)


@query("fn_forecaster", f"with h as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where ts <= timestamp '{CUT}'), m as (select user_id, avg(value) as forecast from h where r <= 4 group by 1) select e.user_id, e.event_id, round(forecast + 1e-9, 5) as forecast from events e left join m using (user_id) where ts > timestamp '{CUT}'")
def forecaster(spark, sf):
    e = events(spark, sf).select("user_id", "ts", "event_id", "value")
    past = F.col("ts") <= F.lit(CUT).cast("timestamp_ntz")
    out = P.forecast_with(e.where(past), e.where(~past).drop("value"), ["user_id"], P.last_value(["user_id"], ["ts", "event_id"], "value", 4), "user_id long, ts timestamp_ntz, event_id long, forecast double")
    return out.select("user_id", "event_id", F.round(F.col("forecast") + 1e-9, 5).alias("forecast"))

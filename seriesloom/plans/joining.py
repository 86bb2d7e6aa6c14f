"""Queries of as-of, range and enriching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .base import query, table, workspace


def events(spark, sf):
    return table(spark, sf, "events")


def errors(spark, sf):
    return events(spark, sf).where("event_type = 'error'").select("user_id", "ts", F.col("value").alias("error_value"), F.col("event_id").alias("error_id"))


def clicks(spark, sf):
    return events(spark, sf).where("event_type = 'click'").select("event_id", "user_id", "ts", "value")


@query("jon1_as_of", "select c.event_id, e.value as error_value, e.event_id as error_id from (select * from events where event_type = 'click') c asof left join (select * from events where event_type = 'error') e on c.user_id = e.user_id and c.ts >= e.ts")
def jon1(spark, sf):
    return J.as_of(clicks(spark, sf), errors(spark, sf), "ts", ["error_value", "error_id"], ("user_id",)).select("event_id", "error_value", "error_id")


@query("jon2_as_of_zones", "select c.event_id, e.event_id as error_id from (select *, ts - interval 9 hour as u from events where event_type = 'click') c asof left join (select *, ts + interval 5 hour as u from events where event_type = 'error') e on c.user_id = e.user_id and c.u >= e.u")
def jon2(spark, sf):
    left = clicks(spark, sf).withColumn("utc", F.convert_timezone(F.lit("Asia/Tokyo"), F.lit("UTC"), "ts"))
    right = errors(spark, sf).withColumn("utc", F.convert_timezone(F.lit("America/Bogota"), F.lit("UTC"), "ts"))
    return J.as_of(left, right, "utc", ["error_id"], ("user_id",)).select("event_id", "error_id")


@query("jon3_covariate_merge", """with s as (select distinct date_trunc('hour', ts) as h from events where event_type = 'view'), m as (select date_trunc('hour', ts) as h, value, ts, event_id from events where event_type = 'purchase'),
d as (select h, value from m qualify row_number() over (partition by h order by ts desc, event_id desc) = 1), k as (select d.h, d.value, s.h as snap from d asof join s on d.h >= s.h), l as (select snap, value from k qualify row_number() over (partition by snap order by h desc) = 1)
select s.h as hour, l.value as covariate from s left join l on s.h = l.snap""")
def jon3(spark, sf):
    e = events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    series = e.where("event_type = 'view'").select("hour").distinct()
    last = e.where("event_type = 'purchase'").groupBy("hour").agg(F.max_by("value", F.struct("ts", "event_id")).alias("covariate"))
    snapped = J.as_of(last, series.withColumn("at", F.col("hour")), "hour", ["at"]).where("at is not null")
    kept = snapped.groupBy("at").agg(F.max_by("covariate", "hour").alias("covariate")).withColumnRenamed("at", "hour")
    return series.join(kept, "hour", "left").select("hour", "covariate")


@query("jon4_combine_on_timestamp", "with d as (select cast(ts as date) as day, event_type, max(value) as v from events group by all) select cast(day as varchar) as day, max(v) filter (event_type = 'click') as click, max(v) filter (event_type = 'error') as error, max(v) filter (event_type = 'view') as view from d where event_type in ('click', 'error', 'view') group by all")
def jon4(spark, sf):
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    return J.combine_on_timestamp({n: e.where(F.col("event_type") == n) for n in ("click", "error", "view")}, "day", "value").withColumn("day", F.col("day").cast("string"))


@query("jon5_two_lookups", """with h as (select cast(ts as date) as day, hour(ts) as hour, count(*) as n from events group by all), p as (select cast(o_orderdate as date) as day, round(avg(o_totalprice) + 1e-9, 2) as price from orders group by all), t as (select hour(ts) as hour, max(value) as top from events group by all)
select cast(day as varchar) as day, h.hour, n, price, top from h left join p using (day) left join t using (hour)""")
def jon5(spark, sf):
    e = events(spark, sf).withColumn("day", F.to_date("ts")).withColumn("hour", F.hour("ts").cast("long"))
    price = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") + 1e-9, 2).alias("price"))
    top = e.groupBy("hour").agg(F.max("value").alias("top"))
    return e.groupBy("day", "hour").agg(F.count("*").alias("n")).join(price, "day", "left").join(top, "hour", "left").select(F.col("day").cast("string").alias("day"), "hour", "n", "price", "top")


@query("jon6_labelled_rows", "select l.l_orderkey, l.l_linenumber, o.o_orderstatus from lineitem l join orders o on l.l_orderkey = o.o_orderkey and l.l_linenumber = o.o_orderkey % 7 + 1")
def jon6(spark, sf):
    labels = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("l_linenumber"), "o_orderstatus")
    return table(spark, sf, "lineitem").join(labels, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("jon7_dimension", "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def jon7(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("jon8_interval_facts", """with f as (select o_orderkey as seq, o_orderdate as s, o_orderdate + to_days(cast(o_orderkey % 5 as integer)) as e, o_orderpriority as fact from orders),
d as (select distinct l_shipdate from lineitem), t as (select l_shipdate, string_agg(fact, ' ' order by seq) as facts from d join f on s <= l_shipdate and l_shipdate <= e group by all)
select l_orderkey, l_linenumber, facts from lineitem join t using (l_shipdate)""")
def jon8(spark, sf):
    facts = table(spark, sf, "orders").selectExpr("o_orderkey as seq", "o_orderdate as s", "o_orderdate + make_dt_interval(cast(o_orderkey % 5 as int)) as e", "o_orderpriority as fact")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    dates = lines.groupBy("l_shipdate").agg(F.ceil(F.count("*") / (1 << 16)).cast("int").alias("slices"))
    met = J.interval_join(dates, facts, "l_shipdate", "s", "e")  # a text per timestamp, however many rows have it
    text = F.array_sort(F.collect_list(F.struct("seq", "fact")))
    texts = met.groupBy("l_shipdate").agg(F.array_join(F.transform(text, lambda x: x["fact"]), " ").alias("facts"), F.first("slices").alias("slices"))
    path = workspace(spark, "jon8")
    texts.write.parquet(path)
    return J.join_texts(lines, spark.read.schema(texts.schema).parquet(path), "l_shipdate", "facts").select("l_orderkey", "l_linenumber", "facts")


@query("jon9_interval_aggregate", """with t as (select distinct user_id, ts as target_ts from events where event_type = 'error'), r as (select user_id, ts, value, event_id from events where event_type <> 'error'),
k as (select r.*, t.target_ts from r asof join t on r.user_id = t.user_id and r.ts <= t.target_ts)
select user_id, target_ts, round(avg(value) + 1e-9, 5) as mean, round(sum(value), 4) as total, max(value) as top, arg_max(value, ts) as last from k group by all""")
def jon9(spark, sf):
    e = events(spark, sf)
    readings = J.next_of(e.where("event_type <> 'error'").select("user_id", "ts", "value"), e.where("event_type = 'error'"), "ts", ("user_id",)).where("target_ts is not null")
    return readings.groupBy("user_id", "target_ts").agg(F.round(F.avg("value") + 1e-9, 5).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top"), F.max_by("value", "ts").alias("last"))


@query("jon10_merge_and_fill", """with d as (select o_custkey, cast(o_orderdate as date) as day, sum(o_totalprice) as spent from orders group by all), f as (select cast(ts as date) as day, count(*) as n from events group by all)
select o_custkey, cast(day as varchar) as day, round(spent, 2) as spent, last_value(case when o_custkey % 3 = 0 and dayofmonth(day) % 2 = 0 then null else c_acctbal end ignore nulls) over (partition by o_custkey order by day rows unbounded preceding) as balance from d join customer on c_custkey = o_custkey""")
def jon10(spark, sf):
    from pyspark.sql import Window

    daily = table(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("spent"))
    joined = daily.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    known = F.when(~((F.col("o_custkey") % 3 == 0) & (F.dayofmonth("day") % 2 == 0)), F.col("c_acctbal"))
    w = Window.partitionBy("o_custkey").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("o_custkey", F.col("day").cast("string").alias("day"), F.round("spent", 2).alias("spent"), F.last(known, ignorenulls=True).over(w).alias("balance"))




def calendar(spark, sf):
    """Every sixth day of the event month, as a calendar with ranks."""
    first = events(spark, sf).agg(F.to_date(F.min("ts")).alias("d"))
    return first.select(F.explode(F.sequence(F.lit(3), F.lit(27), F.lit(6))).alias("k"), "d").select(F.expr("date_add(d, k)").alias("holiday"), (F.col("k") % 5 + 1).alias("rank"))


_CAL = "c0 as (select cast(min(ts) as date) as d from events), cal as (select d + cast(k as integer) as holiday, k % 5 + 1 as rank from c0, (select unnest(range(3, 30, 6)) as k))"


@query("jon11_calendar_lookup", f"with {_CAL} select event_id, holiday is not null as is_holiday, rank from events left join cal on cast(ts as date) = holiday")
def jon11(spark, sf):
    joined = events(spark, sf).withColumn("day", F.to_date("ts")).join(calendar(spark, sf), F.col("day") == F.col("holiday"), "left")
    return joined.select("event_id", F.col("holiday").isNotNull().alias("is_holiday"), F.col("rank").cast("long").alias("rank"))


@query("jon12_holiday_proximity", f"""with {_CAL}, d as (select distinct cast(ts as date) as day from events), m as (select day, holiday, rank, date_diff('day', day, holiday) as gap from d left join cal on abs(date_diff('day', day, holiday)) <= 4)
select cast(day as varchar) as day, coalesce(min(gap) filter (gap >= 0), 4) as days_to_next, coalesce(min(-gap) filter (gap <= 0), 4) as days_since_last, count(gap) as near, round(coalesce(sum((1 - abs(gap) / 5.0) / rank), 0), 6) as closeness from m group by all""")
def jon12(spark, sf):
    dates = events(spark, sf).select(F.to_date("ts").alias("day"))
    return J.calendar_features(dates, calendar(spark, sf), "day", 4).withColumn("closeness", F.round("closeness", 6)).select(F.col("day").cast("string").alias("day"), *[F.col(c).cast("long").alias(c) for c in ("days_to_next", "days_since_last", "near")], "closeness")


def spans(spark, sf):
    return events(spark, sf).where("event_type = 'purchase'").selectExpr("event_id as id", "user_id", "ts as s", "ts + make_dt_interval(0, 0, 0, cast(value * 600 as decimal(18, 6))) as e").withColumn("e", F.date_trunc("second", "e").cast("timestamp_ntz")).withColumn("s", F.date_trunc("second", "s").cast("timestamp_ntz"))


SPANS = "sp as (select event_id as id, user_id, date_trunc('second', ts) as s, date_trunc('second', ts + to_microseconds(cast(round(value * 600 * 1000000) as bigint))) as e from events where event_type = 'purchase')"
PAIRS = f"{SPANS}, pr as (select a.user_id, a.id as a, b.id as b, epoch(least(a.e, b.e)) - epoch(greatest(a.s, b.s)) as shared, greatest(epoch(a.e) - epoch(a.s), epoch(b.e) - epoch(b.s)) as longer from sp a join sp b on a.user_id = b.user_id and a.id < b.id and a.s <= b.e and a.e >= b.s)"


@query("jon13_overlapping_windows", f"with {PAIRS} select user_id, a, b, cast(shared as bigint) as shared from pr")
def jon13(spark, sf):
    return J.overlapping(spans(spark, sf), ["user_id"], "s", "e").select("user_id", "a", "b", "shared")


@query("jon14_window_gaps", f"with {SPANS} select a.user_id, a.id as a, b.id as b, cast(greatest(epoch(b.s) - epoch(a.e), epoch(a.s) - epoch(b.e), 0) as bigint) as gap from sp a join sp b on a.user_id = b.user_id and a.id < b.id where greatest(epoch(b.s) - epoch(a.e), epoch(a.s) - epoch(b.e), 0) <= 86400")
def jon14(spark, sf):
    return J.near_spans(spans(spark, sf), ["user_id"], "s", "e", 86400)


@query("jon15_overlap_share", f"with {PAIRS} select user_id, a, b, round(shared / longer, 6) as share from pr where longer > 0")
def jon15(spark, sf):
    return J.overlapping(spans(spark, sf), ["user_id"], "s", "e").where("share is not null").select("user_id", "a", "b", F.round("share", 6).alias("share"))


@query("jon16_ground_truth", "with f as (select distinct date_trunc('day', ts) + interval 12 hour as noon from events), g as (select date_trunc('hour', ts) as noon, max(value) as truth from events where event_type = 'signup' group by 1) select f.noon, truth from f left join g using (noon)")
def jon16(spark, sf):
    e = events(spark, sf)
    future = e.select((F.date_trunc("day", "ts") + F.expr("interval 12 hours")).cast("timestamp_ntz").alias("noon")).distinct()
    truth = e.where("event_type = 'signup'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("noon")).agg(F.max("value").alias("truth"))
    return future.join(truth, "noon", "left")


@query("jon17_actuals_and_forecasts", """with a as (select event_type as sample_id, ts, value as actual, ts > timestamp '2024-01-25' as target from events), f as (select event_type as sample_id, round(avg(value) + 1e-9, 4) as mean from events where ts <= timestamp '2024-01-25' group by 1)
select sample_id, ts, actual, case when target then mean end as forecast, case when target then 'target' else 'history' end as split from a left join f using (sample_id)""")
def jon17(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("sample_id"), "ts", F.col("value").alias("actual"), (F.col("ts") > F.lit("2024-01-25").cast("timestamp_ntz")).alias("target"))
    mean = e.where("not target").groupBy("sample_id").agg(F.round(F.avg("actual") + 1e-9, 4).alias("mean"))
    forecast = e.where("target").join(mean, "sample_id").select("sample_id", "ts", F.col("mean").alias("forecast")).distinct()
    return e.join(forecast, ["sample_id", "ts"], "left").select("sample_id", "ts", "actual", "forecast", F.when(F.col("target"), "target").otherwise("history").alias("split"))


@query("jon18_backtest_tasks", """with g as (select distinct event_type from events), w as (select unnest(range(0, 3)) as k), c as (select unnest(['none', 'calendar']) as combo), t as (select event_type, k, combo, timestamp '2024-01-10' + to_days(cast(k * 5 as integer)) as cutoff from g, w, c)
select t.event_type, k, combo, count(*) filter (ts <= cutoff) as history, count(*) filter (ts > cutoff and ts <= cutoff + interval 2 day) as horizon from t join events e on e.event_type = t.event_type group by all""")
def jon18(spark, sf):
    e = events(spark, sf)
    tasks = e.select("event_type").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("combo", F.explode(F.array(F.lit("none"), F.lit("calendar"))))
    tasks = tasks.withColumn("cutoff", F.expr("timestamp_ntz'2024-01-10' + make_dt_interval(k * 5)"))
    met = e.join(tasks, "event_type")
    return met.groupBy("event_type", F.col("k").cast("long").alias("k"), "combo").agg(F.count_if(F.col("ts") <= F.col("cutoff")).alias("history"), F.count_if((F.col("ts") > F.col("cutoff")) & (F.col("ts") <= F.col("cutoff") + F.expr("interval 2 days"))).alias("horizon"))


@query("jon19_point_edits", "select event_id, case when event_id % 50 = 0 and event_id % 4 <> 0 then -1.0 when event_id % 50 = 0 then -2.0 else value end as value from events")
def jon19(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "value")
    edits = e.where("event_id % 50 = 0").selectExpr("ts", "'value' as column", "case when event_id % 4 = 0 then -2.0D else -1.0D end as value", "2 as order")
    edits = edits.unionByName(edits.withColumn("value", F.lit(-9.0)).withColumn("order", F.lit(1))).unionByName(edits.withColumn("value", F.lit(None).cast("double")).withColumn("order", F.lit(3)))
    return J.point_edits(e, edits, "ts", ["value"]).select("event_id", "value")


@query("jon20_glued_series", """with p as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as pos from events where event_type in ('click', 'error')), w as (select user_id, pos, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'error') as error from p group by all)
select user_id, pos, last_value(click ignore nulls) over (partition by user_id order by pos) as click, last_value(error ignore nulls) over (partition by user_id order by pos) as error from w""")
def jon20(spark, sf):
    return J.glued(events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type", ["click", "error"], "value").withColumn("pos", F.col("pos").cast("long"))


@query("jon21_leaked_neighbours", "with d as (select event_type, cast(ts as date) as day, round(avg(value) + 1e-9, 4) as v from events group by all) select a.event_type, cast(a.day as varchar) as day, a.v, b.event_type as other, b.v as leaked from d a join d b on a.day = b.day and a.event_type <> b.event_type")
def jon21(spark, sf):
    d = events(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value") + 1e-9, 4).alias("v"))
    return d.join(d.select("day", F.col("event_type").alias("other"), F.col("v").alias("leaked")), "day").where("event_type <> other").select("event_type", F.col("day").cast("string").alias("day"), "v", "other", "leaked")


@query("jon22_closest_value", "with k as (select distinct p_name as value from part), w as (select unnest(['smal rnig', 'RED wigdet', 'blu bolt']) as text), s as (select text, value, 1 - levenshtein(lower(text), lower(value)) / greatest(length(text), length(value), 1) as score from k, w) select text, value, round(score, 6) as score from s qualify row_number() over (partition by text order by score desc, value desc) = 1")
def jon22(spark, sf):
    return J.closest_value(["smal rnig", "RED wigdet", "blu bolt"], table(spark, sf, "part").select(F.col("p_name").alias("value"))).select("text", "value", F.round("score", 6).alias("score"))


@query("jon23_semi_and_anti", "select c_custkey, 'has' as kind from customer where c_custkey in (select o_custkey from orders) union all select c_custkey, 'none' from customer where c_custkey not in (select o_custkey from orders)")
def jon23(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit("has").alias("kind")).unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("kind")))

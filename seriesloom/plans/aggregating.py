"""Queries of aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .base import query, table
from .windowing import WIN, event_windows

L4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = "lf as (" + " union all ".join(f"select '{c}' as column_name, l_returnflag, {c} as value from lineitem" for c in L4) + ")"


def events(spark, sf):
    return table(spark, sf, "events")


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def rounded(df, n, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, n) for c in columns})


@query("agg1_merge_repeated", "select event_type, date_trunc('hour', ts) as hour, round(sum(value), 4) as value, event_type || '!' as label from events group by all")
def agg1(spark, sf):
    e = events(spark, sf).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type", "value", F.concat("event_type", F.lit("!")).alias("label"))
    return A.merge_repeated(e, "hour", ["event_type"], "sum", ["value"], ["label"]).withColumn("value", F.round("value", 4))


@query("agg2_mode", "select l_returnflag, l_quantity as mode from (select l_returnflag, l_quantity, count(*) as n from lineitem group by all) qualify row_number() over (partition by l_returnflag order by n desc, l_quantity) = 1")
def agg2(spark, sf):
    return A.mode_of(lines(spark, sf), ["l_returnflag"], "l_quantity", "mode")


@query("agg3_hourly_counts", "select cast(cast(ts as date) as varchar) as day, hour(ts) as hour, count(*) as n from events group by all")
def agg3(spark, sf):
    return events(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("agg4_rounded_hour_mean", "select date_trunc('hour', ts + interval 30 minute) as hour, round(avg(try_cast(json_extract_string(props, '$.k') as double)) + 1e-9, 5) as mean from events group by 1")
def agg4(spark, sf):
    k = F.expr("try_cast(get_json_object(props, '$.k') as double)")
    return events(spark, sf).groupBy(F.date_trunc("hour", F.col("ts") + F.expr("interval 30 minutes")).cast("timestamp_ntz").alias("hour")).agg(F.round(F.avg(k) + 1e-9, 5).alias("mean"))


@query("agg5_weeks_and_months", "with d as (select cast(o_orderdate as date) as day, o_totalprice as v from orders) select 'week' as grain, cast(day + cast((7 - isodow(day)) as integer) as varchar) as period, round(sum(v), 2) as total, max(v) as top from d group by all union all select 'month', cast(last_day(day) as varchar), round(sum(v), 2), max(v) from d group by all")
def agg5(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"))
    sums = (F.round(F.sum("v"), 2).alias("total"), F.max("v").alias("top"))
    week = d.groupBy(F.next_day(F.date_sub("day", 1), "Sun").cast("string").alias("period")).agg(*sums).select(F.lit("week").alias("grain"), "period", "total", "top")
    month = d.groupBy(F.last_day("day").cast("string").alias("period")).agg(*sums).select(F.lit("month").alias("grain"), "period", "total", "top")
    return week.unionByName(month)


#: Fixed weights of event rank levels.
LEVELS = {"5": 90.0, "4": 70.0, "3": 50.0, "2": 30.0, "1": 10.0}


def ranked_days(spark, sf):
    """Per day a map from rank level (1 .. 5, from props) to a count, as a feature service gives them."""
    k = F.get_json_object("props", "$.k").cast("long")
    counts = events(spark, sf).groupBy(F.to_date("ts").alias("day"), (k % 5 + 1).cast("string").alias("level")).agg(F.count("*").alias("n"))
    return counts.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("levels"))


_LV = "lv as (select cast(cast(ts as date) as varchar) as day, cast(json_extract_string(props, '$.k') as bigint) % 5 + 1 as level from events)"


@query("agg6_event_counts", f"with {_LV} select day, count(*) as n from lv group by 1")
def agg6(spark, sf):
    return ranked_days(spark, sf).select(F.col("day").cast("string").alias("day"), F.explode("levels").alias("level", "n")).groupBy("day").agg(F.sum("n").alias("n"))


@query("agg7_impact_score", f"with {_LV} select day, cast(sum(case level when 5 then 90 when 4 then 70 when 3 then 50 when 2 then 30 else 10 end) as double) as impact from lv group by 1")
def agg7(spark, sf):
    return ranked_days(spark, sf).select(F.col("day").cast("string").alias("day"), A.impact(F.col("levels"), LEVELS, 50.0).alias("impact"))


@query("agg8_category_indicators", "select cast(cast(ts as date) as varchar) as day, max(case when event_type = 'click' then 1 else 0 end) as click, max(case when event_type = 'error' and value > 150 then 1 else 0 end) as error from events group by 1")
def agg8(spark, sf):
    e = events(spark, sf).where("event_type <> 'error' or value > 150").groupBy(F.to_date("ts").cast("string").alias("day")).pivot("event_type", ["click", "error"]).agg(F.max(F.lit(1)))
    days = events(spark, sf).select(F.to_date("ts").cast("string").alias("day")).distinct()
    return days.join(e, "day", "left").fillna(0, ["click", "error"])


@query("agg9_basic_statistics", f"""with {LONG}, s as (select column_name, count(value) as count, avg(value) as m, stddev_pop(value) as sd, min(value) as min, max(value) as max, quantile_cont(value, 0.5) as median from lf group by 1)
select column_name, any_value(count) as count, round(any_value(m), 6) as mean, round(any_value(sd), 6) as std, any_value(min) as min, any_value(max) as max, any_value(median) as median,
round(avg(pow((value - m) / sd, 3)), 6) as skewness, round(avg(pow((value - m) / sd, 4)) - 3, 6) as kurtosis from lf join s using (column_name) group by 1""")
def agg9(spark, sf):
    out = A.basic_statistics(A.long_form(lines(spark, sf), L4), ["column"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "skewness", "kurtosis")}).withColumnRenamed("column", "column_name")


@query("agg10_quantiles", f"with {LONG} select column_name, quantile_cont(value, 0.05) as q5, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.95) as q95 from lf group by 1")
def agg10(spark, sf):
    return A.quantiles(A.long_form(lines(spark, sf), L4), ["column"], [0.05, 0.25, 0.95]).withColumnRenamed("column", "column_name")


_PAIRS = [(a, b) for i, a in enumerate(L4) for b in L4[i + 1 :]]


@query("agg11_pearson", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem" for a, b in _PAIRS))
def agg11(spark, sf):
    return A.correlations(lines(spark, sf), L4).withColumn("corr", F.round("corr", 6))


_RANKS = "r as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in L4) + " from lineitem)"


@query("agg11_spearman", f"with {_RANKS} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from r" for a, b in _PAIRS))
def agg11s(spark, sf):
    return A.correlations(lines(spark, sf), L4, "spearman").withColumn("corr", F.round("corr", 6))


@query("agg12_series_size", "select user_id, count(*) as length, 3 as num_columns, count(*) * 3 as size from events group by 1")
def agg12(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.count("*").alias("length")).withColumn("num_columns", F.lit(3)).withColumn("size", F.col("length") * 3)


@query("agg13_data_length", "select count(*) as n_rows, 6 as n_columns, count(*) * 6 as n_cells from events")
def agg13(spark, sf):
    e = events(spark, sf)
    return e.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(e.columns))).withColumn("n_cells", F.col("n_rows") * len(e.columns))


@query("agg14_column_summary", f"""with {LONG}, s as (select column_name, min(value) as min, max(value) as max, avg(value) as m, stddev_samp(value) as sd, count(distinct value) as n_unique, 0.0 as missing from lf group by 1)
select column_name, any_value(min) as min, any_value(max) as max, any_value(n_unique) as n_unique, any_value(missing) as missing, round(avg(case when abs(value - m) > 1.5 * sd then 1.0 else 0 end), 6) as outliers from lf join s using (column_name) group by 1""")
def agg14(spark, sf):
    return A.column_summary(lines(spark, sf), L4, 1.5).withColumn("outliers", F.round("outliers", 6)).withColumnRenamed("column", "column_name")


@query("agg14_top_values", "with c as (select 'l_returnflag' as column_name, l_returnflag as value, count(*) as n from lineitem group by all union all select 'l_linenumber', cast(l_linenumber as varchar), count(*) from lineitem group by all) select *, row_number() over (partition by column_name order by n desc, value) as place from c qualify place <= 3")
def agg14t(spark, sf):
    return A.top_values(lines(spark, sf), ["l_returnflag", "l_linenumber"], 3).withColumnRenamed("column", "column_name").withColumn("place", F.col("place").cast("long"))


@query("agg15_rows_per_group", "select event_type, user_id, count(*) as n, grouping(event_type) * 2 + grouping(user_id) as level from events group by grouping sets ((event_type), (user_id), ())")
def agg15(spark, sf):
    return events(spark, sf).groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count("*").alias("n"), (F.grouping("event_type").cast("long") * 2 + F.grouping("user_id").cast("long")).alias("level"))


@query("agg16_labels_description", "select (select list(distinct event_type order by event_type) from events) as types, min(value) as low, max(value) as high, min(ts) as first, max(ts) as last from events")
def agg16(spark, sf):
    return events(spark, sf).agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("agg16_label_rows", """with h as (select distinct date_trunc('hour', ts) as hour from events), g as (select date_diff('second', lag(hour) over (order by hour), hour) as gap from h),
st as (select gap from g where gap is not null group by 1 order by count(*) desc, gap limit 1), u as (select 'event_type' as column_name, event_type as item, count(*) as n from events group by 2 union all select 'day', cast(event_id % 7 as varchar), count(*) from events group by 2)
select column_name, 'category' as kind, item, n, null::double as low, null::double as high from u union all select 'value', 'number', null, count(value), min(value), max(value) from events
union all select 'hour', 'time', (select cast(gap as varchar) from st), count(*), null, null from events""")
def agg16r(spark, sf):
    e = events(spark, sf).select("event_type", (F.col("event_id") % 7).cast("string").alias("day"), "value", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    number = lambda c: F.when(F.col("kind") == "number", F.col(c).try_cast("double")).alias(c)
    return A.describe_labels(e, ["event_type", "day"], ["value"], "hour").select("column_name", "kind", "item", "n", number("low"), number("high"))


@query("agg17_window_statistics", f"with {WIN} select event_type, window_idx, round(avg(value) + 1e-9, 5) as mean, min(value) as min, max(value) as max, round(stddev_samp(value) + 1e-9, 5) as std, round(quantile_cont(value, 0.5), 5) as median from w group by all")
def agg17(spark, sf):
    return rounded(A.window_statistics(event_windows(spark, sf), ["event_type", "window_idx"], "value"), 5, "mean", "std").withColumn("median", F.round("median", 5))


@query("agg18_populated_labels", "with t as (select user_id from events group by 1 order by count(*) desc, user_id limit 10) select distinct user_id, event_type from events where user_id in (select user_id from t)")
def agg18(spark, sf):
    return A.populated(events(spark, sf), "user_id", 10, ["user_id", "event_type"]).select("user_id", "event_type")


@query("agg19_combination_ranking", "with c as (select user_id % 7 as combo, user_id, sqrt(avg(value * value)) as rmse from events group by all) select combo, round(avg(rmse), 6) as mean, round(quantile_cont(rmse, 0.5), 6) as median, round(stddev_samp(rmse), 6) as std, round(min(rmse), 6) as low, round(max(rmse), 6) as high, row_number() over (order by avg(rmse)) as place from c group by 1")
def agg19(spark, sf):
    from pyspark.sql import Window

    c = events(spark, sf).groupBy((F.col("user_id") % 7).alias("combo"), "user_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse"))
    out = c.groupBy("combo").agg(F.avg("rmse").alias("mean"), F.median("rmse").alias("median"), F.stddev_samp("rmse").alias("std"), F.min("rmse").alias("low"), F.max("rmse").alias("high"))
    place = F.row_number().over(Window.orderBy("mean")).cast("long").alias("place")  # one row per combination
    return out.select("combo", place, *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "low", "high")])


def results(spark, sf):
    """Error metrics per model: each order status stands for a model."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.avg("o_totalprice").alias("mae"), F.max("o_totalprice").alias("worst"))
    return o


@query("agg20_best_models", "with r as (select o_orderstatus as model, avg(o_totalprice) as mae, max(o_totalprice) as worst from orders group by 1) select 'mae' as metric, arg_min(model, mae) as model, round(min(mae), 3) as value from r union all select 'worst', arg_min(model, worst), round(min(worst), 3) from r")
def agg20(spark, sf):
    return A.best_models(results(spark, sf), ["mae", "worst"]).withColumn("value", F.round("value", 3))


@query("agg21_domain_rollup", "select coalesce(c_mktsegment, 'overall') as domain, round(avg(c_acctbal), 4) as mean, round(stddev_pop(c_acctbal), 4) as std, count(*) as n from customer group by rollup (c_mktsegment)")
def agg21(spark, sf):
    return table(spark, sf, "customer").rollup("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 4).alias("std"), F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("overall")).alias("domain"), "mean", "std", "n")


@query("agg22_clipped_difference", "select l_returnflag, round(greatest(-0.2, least(0.2, avg(l_tax) filter (l_linestatus = 'O') - avg(l_discount) filter (l_linestatus = 'F'))), 6) as diff from lineitem group by 1")
def agg22(spark, sf):
    mean = lambda c, s: F.avg(F.when(F.col("l_linestatus") == s, F.col(c)))
    return lines(spark, sf).groupBy("l_returnflag").agg(F.round(F.greatest(F.lit(-0.2), F.least(F.lit(0.2), mean("l_tax", "O") - mean("l_discount", "F"))), 6).alias("diff"))


@query("agg23_weighted_means", "with g as (select event_type, user_id, count(*) as count, avg(value) as m from events group by all) select event_type, round(sum(m * count) / sum(count), 5) as weighted_mean, round(max(m) + 1e-9, 5) as top from g group by 1")
def agg23(spark, sf):
    g = events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("count"), F.avg("value").alias("m"))
    return A.weighted(g, ["event_type"], "m").select("event_type", F.round("weighted_mean", 5).alias("weighted_mean"), F.round(F.col("top") + 1e-9, 5).alias("top"))


@query("agg24_predictability", "with s as (select user_id, avg(value) / 100 as m, stddev_pop(value) / 100 as s from events group by 1) select user_id, round(greatest(-1, least(1, m * 0.9 - s * 0.4)), 6) as predictability from s")
def agg24(spark, sf):
    s = events(spark, sf).groupBy("user_id").agg((F.avg("value") / 100).alias("m"), (F.stddev_pop("value") / 100).alias("s"))
    return s.select("user_id", F.round(A.clipped_weighted({"m": 0.9, "s": -0.4}), 6).alias("predictability"))


@query("agg24_multivariate", "with s as (select user_id, event_type, event_id % 7 as col, avg(value) / 60 as v from events group by all), m as (select user_id, event_type, max(greatest(0, least(1, v))) * 0.6 + avg(greatest(0, least(1, v))) * 0.4 as s from s where col <> 6 group by all) select user_id, round(avg(s), 6) as score from m group by 1")
def agg24m(spark, sf):
    s = events(spark, sf).groupBy("user_id", "event_type", (F.col("event_id") % 7).alias("col")).agg((F.avg("value") / 60).alias("v"))
    return A.multivariate_score(s, ["user_id"], "event_type", "v", 0.6, 0.4, F.col("col") == 6).withColumn("score", F.round("score", 6))


@query("agg25_combined_scores", "with s as (select event_type, user_id, greatest(0, avg(value) - 40) as v from events group by all) select event_type, round(avg(v), 5) as mean, round(max(v), 5) as max, round(quantile_cont(v, 0.5), 5) as median, round(avg(v) filter (v <> 0), 5) as mean_nonzero, round(quantile_cont(v, 0.5) filter (v <> 0), 5) as median_nonzero, count(*) as groups from s group by 1")
def agg25(spark, sf):
    s = events(spark, sf).groupBy("event_type", "user_id").agg(F.greatest(F.lit(0.0), F.avg("value") - 40).alias("v"))
    return A.combine_scores(s, ["event_type"], "v").withColumns({c: F.round(c, 5) for c in ("mean", "max", "median", "mean_nonzero", "median_nonzero")})


@query("agg26_group_features", "with g as (select event_type, user_id, avg(value) as m from events group by all) select event_type, round(avg(m), 5) as mean_of_means, round(var_pop(m), 4) as var_of_means from g group by 1")
def agg26(spark, sf):
    g = events(spark, sf).groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return g.groupBy("event_type").agg(F.round(F.avg("m"), 5).alias("mean_of_means"), F.round(F.var_pop("m"), 4).alias("var_of_means"))


@query("agg27_regressions", "with b as (select user_id, avg(value) as base from events where ts < timestamp '2024-01-15' group by 1), n as (select user_id, avg(value) as value from events where ts >= timestamp '2024-01-15' group by 1) select user_id, round((value - base) / base * 100, 5) as change, abs((value - base) / base * 100) > 10 as flag from n join b using (user_id)")
def agg27(spark, sf):
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    mean = lambda c: events(spark, sf).where(c).groupBy("user_id").agg(F.avg("value").alias("value"))
    return A.regressions(mean(half), mean(~half), ["user_id"], "value", 0.1).select("user_id", F.round("change", 5).alias("change"), "flag")


@query("agg28_channel_ranges", f"with {LONG} select column_name, min(value) as low, max(value) as high from lf group by 1")
def agg28(spark, sf):
    return A.long_form(lines(spark, sf), L4).groupBy(F.col("column").alias("column_name")).agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query("agg29_distinct", "select distinct event_type, user_id from events")
def agg29(spark, sf):
    return events(spark, sf).select("event_type", "user_id").distinct()


@query("agg30_zero_filled_days", "with d as (select unnest(generate_series(date_trunc('day', (select min(ts) from events)), date_trunc('day', (select max(ts) from events)), interval 1 day)) as day), c as (select date_trunc('day', ts) as day, count(*) as n from events where event_type = 'purchase' and value > 120 group by 1) select cast(cast(d.day as date) as varchar) as day, coalesce(n, 0) as n from d left join c using (day)")
def agg30(spark, sf):
    from ..operators.grid import spine

    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    counts = e.where("event_type = 'purchase' and value > 120").groupBy("day").agg(F.count("*").alias("n"))
    return spine(e, [], "day", "interval 1 day").join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("agg31_dataset_descriptors", "with s as (select event_type, user_id, count(*) as n from events group by all) select event_type, cast(sum(n) as bigint) as points, min(n) as low, round(avg(n), 5) as mean, max(n) as high, count(*) as series from s group by 1")
def agg31(spark, sf):
    s = events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("event_type").agg(F.sum("n").alias("points"), F.min("n").alias("low"), F.round(F.avg("n"), 5).alias("mean"), F.max("n").alias("high"), F.count("*").alias("series"))


@query("agg31_with_models", "with s as (select event_type, user_id, count(*) as n from events group by all), d as (select event_type, cast(sum(n) as bigint) as points, min(n) as low, round(avg(n), 5) as mean, max(n) as high, count(*) as series from s group by 1), r as (select event_type, 'm' || (event_id % 3) as model, value as mape from events where event_type <> 'view' qualify row_number() over (partition by event_type, event_id % 3 order by ts desc, event_id desc) = 1) select d.*, model, mape from d left join r using (event_type)")
def agg31m(spark, sf):
    results = events(spark, sf).where("event_type <> 'view'").select("event_type", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), "ts", "event_id", F.col("value").alias("mape"))
    return A.dataset_descriptors(events(spark, sf), "event_type", ["user_id"], results, "model", ["ts", "event_id"], "mape").withColumn("mean", F.round("mean", 5))

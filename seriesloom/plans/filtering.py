"""Queries of filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import projections as P
from .base import query, table
from .windowing import WIN, event_windows

KEYS = ["event_type", "window_idx"]


def events(spark, sf):
    return table(spark, sf, "events")


def catalog(spark, sf):
    """One row per user series, with a frequency and nested column records derived from it."""
    e = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("length"), F.count_distinct("event_type").alias("num_columns"), F.array_sort(F.collect_set("event_type")).alias("types"))
    frequency = F.element_at(F.array(*map(F.lit, L.FREQUENCIES)), (F.col("user_id") % 6 + 1).cast("int"))
    columns = F.transform("types", lambda t: F.struct(t.alias("title"), F.concat(F.lit("About "), t).alias("description")))
    return e.select("user_id", "length", "num_columns", (F.col("length") * F.col("num_columns")).alias("size"), frequency.alias("frequency"), columns.alias("columns"))


CATALOG = """c as (select user_id, count(*) as length, count(distinct event_type) as num_columns, count(*) * count(distinct event_type) as size, list(distinct event_type) as types,
['yearly', 'quarterly', 'monthly', 'weekly', 'daily', 'hourly'][user_id % 6 + 1] as frequency from events group by 1)"""


@query("flt1_group_filter", "select event_id, event_type, user_id from events where (event_type in ('click', 'view') or user_id in (3, 5)) and (user_id in (1, 2, 3, 5, 8))")
def flt1(spark, sf):
    return L.group_filter(events(spark, sf), [{"event_type": ["click", "view"], "user_id": ["3", 5.0]}, {"user_id": [1, "2", 3, 5, 8, "x", 2.5]}]).select("event_id", "event_type", "user_id")


@query("flt4_metadata_filter", f"with {CATALOG} select user_id, length, size, frequency from c where length >= 30 and num_columns <= 5 and user_id % 6 >= 2 and len(list_filter(types, lambda t: contains(t, 'click'))) > 0")
def flt4(spark, sf):
    return L.metadata_filter(catalog(spark, sf), length_geq=30, num_columns_leq=5, frequency_geq="Monthly", keyword="CLICK").select("user_id", "length", "size", "frequency")


@query("flt5_combined_predicates", f"with {CATALOG} select user_id from c where (user_id % 6 = 4 or size >= 300) and not (length <= 40)")
def flt5(spark, sf):
    m = L.metadata_condition
    return catalog(spark, sf).where((m("frequency_eq", "daily") | m("size_geq", 300)) & ~m("length_leq", 40)).select("user_id")


@query("flt6_time_slice", "select event_id from events where ts between timestamp '2024-01-05' and timestamp '2024-01-09 12:00:00'")
def flt6(spark, sf):
    return L.time_slice(events(spark, sf), "ts", "2024-01-05", "2024-01-09 12:00:00").select("event_id")


@query("flt7_series_by_length", "select event_id, user_id from events where user_id in (select user_id from events group by 1 having count(*) between 20 and 70)")
def flt7(spark, sf):
    return L.series_by_length(events(spark, sf), ["user_id"], 20, 70).select("event_id", "user_id")


def _windows(condition, rows="event_type, window_idx, event_id"):
    return f"with {WIN}, ok as (select event_type, window_idx from w group by all having {condition}) select {rows} from w semi join ok using (event_type, window_idx)"


def _kept(spark, sf, condition):
    return L.keep_windows(event_windows(spark, sf), condition, KEYS).select(*KEYS, "event_id")


@query("flt8_windows_by_label", _windows("bool_or(event_type || '-' || user_id in ('click-7', 'view-12'))"))
def flt8(spark, sf):
    return _kept(spark, sf, L.labelled(["event_type", "user_id"], ["click-7", "view-12"]))


@query("flt9_windows_in_ranges", _windows("min(value) >= 1 and max(value) <= 180"))
def flt9(spark, sf):
    return _kept(spark, sf, L.in_ranges({"value": (1, 180)}))


@query("flt10_windows_in_options", _windows("bool_and(event_type in ('click', 'error'))"))
def flt10(spark, sf):
    return _kept(spark, sf, L.in_options({"event_type": ["click", "error"]}))


@query("flt11_windows_all_filters", f"""with {WIN}, ok as (select event_type, window_idx from w group by all having min(value) >= 0.5 and max(value) <= 300 and bool_and(event_type in ('click', 'error', 'view')) and bool_or(user_id between 1 and 40))
select count(distinct new_idx) as n, min(new_idx) as low, max(new_idx) as high, cast(sum(k) as bigint) as kept from (select row_number() over (order by event_type, window_idx) - 1 as new_idx, count(*) as k from w semi join ok using (event_type, window_idx) group by event_type, window_idx)""")
def flt11(spark, sf):
    every = L.in_ranges({"value": (0.5, 300)}) & L.in_options({"event_type": ["click", "error", "view"]}) & F.bool_or(F.col("user_id").between(1, 40))
    kept = L.renumbered(L.keep_windows(event_windows(spark, sf), every, KEYS), KEYS)
    return kept.agg(F.count_distinct("new_idx").alias("n"), F.min("new_idx").alias("low"), F.max("new_idx").alias("high"), F.count("*").alias("kept"))


@query("flt12_windows_inside", _windows("count(*) filter (ts between timestamp '2024-01-10' and timestamp '2024-01-20') = 24"))
def flt12(spark, sf):
    return _kept(spark, sf, L.inside("ts", "2024-01-10", "2024-01-20", 24))


@query("flt13_windows_in_slot", _windows("bool_or(hour(ts) between 9 and 10 and isodow(ts) = 3)"))
def flt13(spark, sf):
    return _kept(spark, sf, L.in_slot("ts", hour=9, day_of_week=3))


@query("flt14_windows_by_statistic", _windows("stddev_samp(value) > 45.0 and quantile_cont(value, 0.5) <= 40.0"))
def flt14(spark, sf):
    return _kept(spark, sf, L.by_statistic("value", "sd", "gt", 45.0) & L.by_statistic("value", "median", "leq", 40.0))


@query("flt14_windows_by_percentile", f"with {WIN}, m as (select event_type, window_idx, quantile_cont(value, 0.5) as m from w group by all) select event_type, window_idx, event_id from w semi join (select * from m where m >= (select quantile_cont(m, 0.9) from m where m <> 0)) using (event_type, window_idx)")
def flt14b(spark, sf):
    return L.by_percentile(event_windows(spark, sf), KEYS, "value", "geq", 0.9, zeros=False).select(*KEYS, "event_id")


@query("flt15_windows_by_category", f"with {WIN}, f as (select event_type, window_idx, bool_or(user_id in (5, 6, 7)) as i, bool_or(user_id in (1, 2)) as x from w group by all) select event_type, window_idx, event_id from w semi join (select * from f where not x and (i or not (select bool_or(i) from f))) using (event_type, window_idx)")
def flt15(spark, sf):
    return L.by_category(event_windows(spark, sf), KEYS, "user_id", [5, 6, 7], [1, 2]).select(*KEYS, "event_id")


@query("flt16_substring_search", "select c_name, c_custkey from customer where contains(lower(c_name), '#0000001') order by c_name limit 100")
def flt16(spark, sf):
    return L.substring_search(table(spark, sf, "customer"), "c_name", "#0000001", 100).select("c_name", "c_custkey")


@query("flt17_regex_search", "select doc_id, n_chars from documents where regexp_matches(text, '(?i)licensed? under') order by doc_id limit 50")
def flt17(spark, sf):
    return L.regex_search(table(spark, sf, "documents"), "text", "(?i)licensed? under", "doc_id", 50).select("doc_id", "n_chars")


@query("flt18_cutoff_use", "select user_id, min(ts) < timestamp '2024-01-02' as train, max(ts) > timestamp '2024-01-29' as test from events group by 1")
def flt18(spark, sf):
    e = events(spark, sf)
    use = L.cutoff_use(e, ["user_id"], "ts", "2024-01-02").select("user_id", "train")
    return use.join(L.cutoff_use(e, ["user_id"], "ts", "2024-01-29").select("user_id", "test"), "user_id")


@query("flt19_varying_series", "select event_id from events where user_id in (select user_id from events group by 1 having var_pop(round(value / 400)) > 0)")
def flt19(spark, sf):
    return L.varying(events(spark, sf).withColumn("level", F.round(F.col("value") / 400)), ["user_id"], "level").select("event_id")


@query("prj2_timestamp_candidates", "select 'ts' as column_name, 0.0 as null_share")
def prj2(spark, sf):
    return P.timestamp_candidates(events(spark, sf)).withColumnRenamed("column", "column_name")


@query("prj3_categories", "select 'l_returnflag' as column_name, l_returnflag as value from lineitem union select 'l_linestatus', l_linestatus from lineitem union select 'l_linenumber', cast(l_linenumber as varchar) from lineitem union select 'l_quantity', cast(l_quantity as varchar) from lineitem")
def prj3(spark, sf):
    return P.categories(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_partkey")).withColumnRenamed("column", "column_name")


@query("prj4_invariant_columns", "select 'event_type' as column_name, count(distinct event_type) as n, count(distinct event_type) <= 1 as invariant from events union all select 'user_id', count(distinct user_id), count(distinct user_id) <= 1 from events union all select 'year', count(distinct year(ts)), count(distinct year(ts)) <= 1 from events")
def prj4(spark, sf):
    return P.distinct_counts(events(spark, sf).select("event_type", "user_id", F.year("ts").alias("year"))).withColumnRenamed("column", "column_name")


@query("prj6_missing_columns", "select event_id, value, 0.0 as humidity from events")
def prj6(spark, sf):
    return P.with_missing(events(spark, sf).select("event_id", "value"), ["value", "humidity"])


@query("prj9_hidden_future", "select event_id, case when ts <= timestamp '2024-01-25' then value end as value, user_id from events")
def prj9(spark, sf):
    marked = events(spark, sf).withColumn("future", F.col("ts") > F.lit("2024-01-25").cast("timestamp_ntz"))
    return P.hide_future(marked, "future", ["value", "user_id"], ["user_id"]).select("event_id", "value", "user_id")

"""Queries of sources, sinks, streaming jobs and scalar functions.

Streaming jobs run as streams over the events as files, in append mode until
all files are read, so their SQL counts what the watermark has closed by then."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clip, safe_divide
from ..sources import readers as S
from ..sources import writers as K
from ..streaming import jobs
from .base import query, table, workspace
from .windowing import WIN, event_windows


def events(spark, sf):
    return table(spark, sf, "events")


@query("src1_read_table", "select event_id, ts, value from events")
def src1(spark, sf):
    return S.read_table(spark, f"{sf}/events.parquet", ["event_id", "ts", "value"])


@query("src2_stacked", "select cast(c_custkey as varchar) as id, c_acctbal as balance, 0 as _source_id from customer union all select s_name, s_acctbal, 1 from supplier")
def src2(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return S.stacked([a, table(spark, sf, "supplier").select(F.col("s_name").alias("id"), F.col("s_acctbal").alias("balance"))])


@query("src3_timestamp_parts", "select event_id, date_trunc('hour', ts) as timestamp from events")
def src3(spark, sf):
    parts = events(spark, sf).select("event_id", *[f("ts").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))])
    return S.timestamp_of(parts)


_COLS = ["l_quantity", "l_discount", "l_tax"]


@query("src5_column_series", " union all ".join(f"select l_orderkey, l_linenumber, '{c}' as column_id, l_shipdate, {c} as value from lineitem" for c in _COLS))
def src5(spark, sf):
    return S.column_series(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", _COLS)


@query("src6_column_metadata", " union all ".join(f"select '{c}' as column_id, min(l_shipdate) as start, max(l_shipdate) as \"end\", count(*) as length, count({c}) as known from lineitem" for c in _COLS))
def src6(spark, sf):
    long = table(spark, sf, "lineitem").select("l_shipdate", *_COLS).unpivot(["l_shipdate"], _COLS, "column_id", "value")
    return S.series_metadata(long, ["column_id"], "l_shipdate")


@query("src7_group_metadata", "select event_type || '_' || user_id as series_id, min(ts) as start, max(ts) as \"end\", count(*) as length, count(value) as known from events group by 1")
def src7(spark, sf):
    return S.series_metadata(events(spark, sf).withColumn("series_id", F.concat_ws("_", "event_type", "user_id")), ["series_id"], "ts")


@query("src8_column_json", "select user_id, event_id as idx, event_type, cast(value as varchar) as value from events")
def src8(spark, sf):
    posted = S.to_column_json(events(spark, sf), ["user_id"], "event_id", ["event_type", "value"])
    return S.from_column_json(posted, "payload", ["user_id"], ["event_type", "value"])


@query("src9_windows_to_rows", f"with {WIN} select event_type, window_idx, step, event_id, value from w")
def src9(spark, sf):
    from ..operators.windows import window_arrays

    arrays = window_arrays(event_windows(spark, sf), ["event_type"], ["event_id", "value"])
    return S.long_from_arrays(arrays, ["event_type", "window_idx"], ["event_id", "value"]).withColumn("step", F.col("step").cast("long"))


@query("src11_long_to_wide", "with d as (select cast(cast(ts as date) as varchar) as day, event_type, value from events) select day, round(avg(value) filter (event_type = 'click') + 1e-9, 5) as click, round(avg(value) filter (event_type = 'view') + 1e-9, 5) as view from d where event_type in ('click', 'view') group by 1")
def src11(spark, sf):
    d = events(spark, sf).where("event_type in ('click', 'view')").withColumn("day", F.to_date("ts").cast("string"))
    return S.wide_from_long(d, ["day"], "event_type", "value", ["click", "view"]).withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("click", "view")})


@query("src12_dated_table", "select event_id, date_trunc('minute', ts) as at_minute from events where event_id % 4 <> 0")
def src12(spark, sf):
    text = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm"))
    return S.dated_table(events(spark, sf).select("event_id", text.alias("at_minute")), "at_minute", "yyyy/MM/dd HH:mm")


@query("src13_long_groups", "select event_id from events where user_id in (select user_id from events group by 1 having count(*) >= 25)")
def src13(spark, sf):
    return S.long_groups(events(spark, sf), [(["user_id"], 25)]).select("event_id")


@query("src14_path_parts", "select n_nationkey, 'nation' as source_table from nation")
def src14(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", S.path_part(r"(\w+)\.parquet").alias("source_table"))


@query("src16_value_arrays", "with p as (select user_id, value, date_trunc('day', min(ts) over (partition by user_id)) + to_hours(cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer)) as ts from events) select * from p")
def src16(spark, sf):
    stored = events(spark, sf).groupBy("user_id").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    return S.from_value_arrays(stored, ["user_id"], "start", "v", "interval 1 hour")


@query("src17_two_sizes", "with a as (select * from events where user_id in (select user_id from events group by 1 having count(*) >= 10)) select event_id from a where (user_id, event_type) in (select user_id, event_type from a group by all having count(*) >= 8)")
def src17(spark, sf):
    return S.long_groups(events(spark, sf), [(["user_id"], 10), (["user_id", "event_type"], 8)]).select("event_id")


@query("src18_weather_rows", "select date_trunc('day', ts) + to_hours(cast(hour(ts) as integer)) as ts, 'temp' as parameter, max(value) as value from events group by 1")
def src18(spark, sf):
    hourly = events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d"), (F.hour("ts") * 100).cast("string").alias("time")).agg(F.max("value").cast("string").alias("temp"))
    days = hourly.groupBy("d").agg(F.struct(F.collect_list(F.create_map(F.lit("time"), "time", F.lit("temp"), "temp")).alias("hourly")).alias("h"))
    return S.weather_rows(days.select(F.to_json(F.struct(F.create_map("d", "h").alias("historical"))).alias("payload")), "payload")


@query("snk1_new_series", "select event_id from events where user_id not in (select user_id from events where value > 200)")
def snk1(spark, sf):
    saved = events(spark, sf).where("value > 200")
    return K.new_series(events(spark, sf), saved, ["user_id"]).select("event_id")


@query("snk4_queried_samples", "select event_id, value from events where value > 50 and event_type = 'view' order by event_id limit 40")
def snk4(spark, sf):
    return S.queried_samples(events(spark, sf), "value > 50 and event_type = 'view'", ["event_id", "value"], "event_id", 40)


@query("snk5_latest_results", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def snk5(spark, sf):
    return S.latest_rows(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


#: The events as a file stream: a pattern, so that it may be a file or a folder of files.
EVENTS = "{}/events.parque[t]"
#: What the watermark has passed once a stream has read the whole table.
_CLOSED = "(select max(ts) from events) - interval {}"


def streamed(spark, sf, name, job):
    """A job over the events as a file stream, run over all that is there."""
    path = workspace(spark, name)
    return jobs.run_to_files(job(jobs.event_stream(spark, EVENTS.format(sf))), f"{path}/out", f"{path}/checkpoint")


@query("str1_usage_counts", f"select date_trunc('hour', ts) as start, event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by all having date_trunc('hour', any_value(ts)) + interval 1 hour <= {_CLOSED.format('30 minute')}")
def str1(spark, sf):
    """The counts that the stream has passed on: those of hours that the watermark has closed."""
    return streamed(spark, sf, "str1", jobs.usage_counts).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "k")


@query("str1_endpoint_health", f"""with r as (select date_trunc('hour', ts) as start, '/v' || (user_id % 3) as endpoint, case event_type when 'error' then 500 when 'signup' then 404 else 200 end as status, value from events)
select start, endpoint, count(*) as n, round(avg(case when status >= 400 then 1.0 else 0.0 end), 6) as error_share, round(avg(value) + 1e-7, 5) as mean_latency, max(value) as worst_latency from r group by all having start + interval 1 hour <= {_CLOSED.format('30 minute')}""")
def str1h(spark, sf):
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    health = streamed(spark, sf, "str1h", lambda s: jobs.endpoint_health(s, F.concat(F.lit("/v"), (F.col("user_id") % 3).cast("string")), status, F.col("value")))
    return health.select(F.col("start").cast("timestamp_ntz").alias("start"), "endpoint", "n", F.round("error_share", 6).alias("error_share"), F.round(F.col("mean_latency") + 1e-7, 5).alias("mean_latency"), "worst_latency")


@query("str2_payload_batch", "select event_id, value from events where event_type = 'click'")
def str2(spark, sf):
    """Payloads posted by users, one a user and hour, through foreachBatch."""
    columns = ["event_id", "event_type", "value"]

    def each(batch):
        posted = S.to_column_json(batch.withColumn("slot", F.date_trunc("hour", "ts")), ["user_id", "slot"], "event_id", columns)
        return jobs.payload_batch(posted, columns, [{"event_type": ["click"]}], "event_id", ["event_type"], ["value"])

    path = workspace(spark, "str2")
    out = jobs.run_batches(jobs.event_stream(spark, EVENTS.format(sf)), each, f"{path}/out", f"{path}/checkpoint")
    return out.select(F.col("event_id").cast("long").alias("event_id"), "value")


@query("str3_rolling_scores", f"with b as (select event_type, avg(value) as mean, stddev_pop(value) / 4 as spread from events group by 1), w as (select date_trunc('hour', ts) - to_hours(cast(k as integer)) as start, event_type, avg(value) as m from events, (select unnest(range(0, 6)) as k) group by all having date_trunc('hour', any_value(ts)) - to_hours(cast(any_value(k) as integer)) + interval 6 hour <= {_CLOSED.format('1 hour')}) select start, event_type, round(abs(m - mean) / (spread + 1e-6), 4) as score from w join b using (event_type) where abs(m - mean) / (spread + 1e-6) > 1.0")
def str3(spark, sf):
    base = events(spark, sf).groupBy("event_type").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") / 4).alias("spread"))
    return streamed(spark, sf, "str3", lambda stream: jobs.rolling_scores(stream, base)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("score", 4).alias("score"))


@query("str4_without_repeats", "select distinct user_id, event_type, cast(floor(value) as bigint) as level from events")
def str4(spark, sf):
    """Repeats within 60 days, which is longer than the table."""
    keys = ["user_id", "event_type", "level"]
    return streamed(spark, sf, "str4", lambda stream: jobs.without_repeats(stream.withColumn("level", F.floor("value")), keys, "60 days")).select(*keys)


@query("str5_sessions", "with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 2 hour then 0 else 1 end as k from events), s as (select *, sum(k) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, max(ts) + interval 2 hour as \"end\", count(*) as n from s group by user_id, s having max(ts) + interval 2 hour <= " + _CLOSED.format("1 hour"))
def str5(spark, sf):
    """The sessions that the watermark has closed."""
    s = streamed(spark, sf, "str5", jobs.sessions)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("fn_safe_divide_and_clip", "select l_orderkey, l_linenumber, coalesce(l_quantity / nullif(l_discount, 0), 0) as ratio, greatest(5, least(40, l_quantity)) as clipped from lineitem")
def fn1(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", safe_divide("l_quantity", "l_discount").alias("ratio"), clip(F.col("l_quantity"), 5.0, 40.0).alias("clipped"))


@query("src4_catalog", "select event_type, count(*) as length, min(ts) as start from events group by 1")
def src4(spark, sf):
    """One metadata file a series, as a catalog has them, read with the files' names."""
    meta = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("length"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"))
    path = workspace(spark, "src4")
    meta.write.option("maxRecordsPerFile", 1).json(path)
    found = S.catalog(spark, path).where("source_file is not null")
    return found.select("event_type", F.col("length").cast("long").alias("length"), F.col("start").cast("timestamp_ntz").alias("start"))


@query("src5_chosen_series", "with s as (select event_type || '-' || (user_id % 10) as series_id, event_id, value from events), c as (select series_id, avg(value) as mean, count(*) as length from s group by 1) select series_id, event_id, value from s where series_id in (select series_id from c where series_id like 'click%' and mean > 45 and length > 2)")
def src5c(spark, sf):
    """Series saved in folders with a catalog; a second save of the same series adds nothing; then those that the catalog picks are read."""
    path = workspace(spark, "src5")
    long = events(spark, sf).withColumn("series_id", F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")))
    first = long.where("event_type <> 'view'")
    K.save_series(first, f"{path}/data", ["series_id"])
    K.save_catalog(first, f"{path}/catalog", "series_id", "ts", "value")
    saved = spark.read.parquet(f"{path}/catalog")
    fresh = K.new_series(long, saved, ["series_id"])
    K.save_series(fresh, f"{path}/data", ["series_id"])
    K.save_catalog(fresh, f"{path}/catalog", "series_id", "ts", "value")
    return S.chosen_series(spark, f"{path}/data", spark.read.parquet(f"{path}/catalog"), "series_id like 'click%' and mean > 45 and length > 2", columns=["event_id", "value"])


@query("src10_nested_to_wide", "select user_id, date_trunc('day', ts) as day, round(max(value) filter (event_type = 'click'), 4) as click, round(max(value) filter (event_type = 'error'), 4) as error from events where event_type in ('click', 'error') group by all")
def src10(spark, sf):
    day = events(spark, sf).where("event_type in ('click', 'error')").groupBy("user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.max("value").alias("v"))
    nested = day.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("r"))
    long = S.long_from_arrays(nested.select("user_id", "event_type", F.col("r.day").alias("day"), F.col("r.v").alias("v")), ["user_id", "event_type"], ["day", "v"])
    return S.wide_from_long(long, ["user_id", "day"], "event_type", "v", ["click", "error"]).withColumns({c: F.round(c, 4) for c in ("click", "error")})


@query("src15_timestamp_from_parts", "select o_orderkey, date_trunc('day', o_orderdate) as timestamp from orders")
def src15(spark, sf):
    o = table(spark, sf, "orders")
    return S.timestamp_of(o.select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day")))


@query("snk2_dataset_description", "select event_type, count(*) as rows, min(ts) as first, max(ts) as last from events where value > 10 group by 1")
def snk2(spark, sf):
    """Each dataset saved in another format, with its description."""
    kinds = {"click": "csv", "error": "json"}
    kept, path, found = events(spark, sf).where("value > 10"), workspace(spark, "snk2"), None
    for name in [r[0] for r in kept.select("event_type").distinct().orderBy("event_type").collect()]:  # names of event types
        one = K.save_dataset(kept.where(F.col("event_type") == name), f"{path}/{name}", "ts", kinds.get(name, "parquet")).select(F.lit(name).alias("event_type"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query("snk3_saved_samples", f"with {WIN}, a as (select event_type, window_idx, list(value order by step) as v from w group by all) select case when window_idx % 5 = 0 then 'val' else 'train' end as split, event_type, window_idx, v[1:18] as history, v[19:24] as target from a")
def snk3(spark, sf):
    from ..operators.windows import history_and_target, window_arrays

    samples = history_and_target(window_arrays(event_windows(spark, sf), ["event_type"], ["value"]), "value", 18, 6).drop("value")
    path = workspace(spark, "snk3")
    K.save_samples(samples.withColumn("split", F.when(F.col("window_idx") % 5 == 0, "val").otherwise("train")), path)
    return spark.read.parquet(path).select("split", "event_type", "window_idx", "history", "target")


@query("snk6_saved_results", "select user_id, count(*) as n, min(value) as low, max(value) as high from events group by 1")
def snk6(spark, sf):
    results = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    path = workspace(spark, "snk6")
    K.save_results(results, path)
    return K.load_results(spark, path, results.schema)


@query("snk7_usage_rows", "select event_id as call_id, sha256(cast(user_id as varchar)) as user_key, event_type as endpoint, case when event_type = 'error' then 'failed' when value > 200 then 'rejected' else 'success' end as status from events")
def snk7(spark, sf):
    code = F.when(F.col("event_type") == "error", 500).when(F.col("value") > 200, 429).otherwise(200)
    calls = events(spark, sf).select(F.col("event_id").alias("call_id"), "ts", F.col("user_id").alias("user"), F.col("event_type").alias("endpoint"), code.alias("code"), F.col("value").alias("seconds"))
    path = workspace(spark, "snk7")
    K.append_usage(calls, path)
    return spark.read.parquet(path).select("call_id", "user_key", "endpoint", "status")


@query("smp4_training_tables", f"with {WIN}, pk as (select *, row_number() over (order by md5(cast(event_type as varchar) || '|' || window_idx), event_type, window_idx) as r from (select distinct event_type, window_idx from w)) select event_type, window_idx, list(value order by step) as value, list(hour(ts) order by step) as hours from w semi join (select * from pk where r <= 50) using (event_type, window_idx) group by all")
def smp4(spark, sf):
    from ..operators.windows import window_arrays

    w = event_windows(spark, sf)
    chosen = w.select("event_type", "window_idx").distinct().orderBy(F.md5(F.concat_ws("|", "event_type", F.col("window_idx").cast("string"))), "event_type", "window_idx").limit(50)
    rows = w.join(F.broadcast(chosen), ["event_type", "window_idx"], "left_semi").withColumn("hours", F.hour("ts").cast("long"))
    return window_arrays(rows, ["event_type"], ["value", "hours"])

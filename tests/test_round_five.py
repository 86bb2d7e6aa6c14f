"""Steps that have to grow no faster than their input: what they give, and what their plans do not have."""

from __future__ import annotations

import random

from seriesloom.operators import anomalies, order_statistics, scaling
from seriesloom.sources import readers

from test_round_four import agree, at  # noqa: F401  (a fixture)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_scaled_holds_no_group_in_one_task(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 5.0), (None, 4.0, 4.0), (None, 6.0, 7.0), ("c", 2.0, 2.0), ("d", None, 1.0)], "k string, x double, y double")
    out = scaling.range_scaled(df, ["k"], "x", a="x", f="y")
    assert "Window" not in plan(out)
    assert sorted(((r["k"] or "", r["x"] or 0.0, r["a"], r["f"]) for r in out.collect()), key=repr) == sorted([("a", 1.0, 0.0, 0.5), ("a", 3.0, 1.0, 2.0), ("", 4.0, 0.0, 0.0), ("", 6.0, 1.0, 1.5), ("c", 2.0, None, None), ("d", 0.0, None, None)], key=repr)


def test_concurrent_makes_no_pairs(spark, agree):  # noqa: F811
    """Dense seconds, copies of rows, spans that end at a second and one before, and seconds before and after 1970, against all pairs."""
    r = random.Random(7)
    events = [(i, at(r.choice([0, 0.25, 5.9997, 6, 6.0003, 11, 12, 12.0002, 500, -500000, -500003])), 1, r.choice("abcd"), float(r.choice([100, 121, 130.5, 200]))) for i in range(150)]
    assert agree("ano7_concurrent", events)
    found = spark.createDataFrame([(at(0), "a", 1.0)], "t timestamp_ntz, k string, v double")
    assert "Generate" not in plan(anomalies.concurrent(found, "t", "k", "v", 60, 1))


def test_columns_without_gaps_are_not_moved(spark):
    full = spark.createDataFrame([(i // 4, i, float(i), None if i % 4 in (0, 2) else 1.0) for i in range(12)], "k int, ts int, x double, y double")
    assert "Exchange" not in plan(readers.column_series(full, ["k"], "ts", ["x"]))
    found = sorted((r["column_id"], r["k"], r["ts"], r["value"]) for r in readers.column_series(full, ["k"], "ts", ["x", "y"]).fillna(-1.0).collect())
    assert found == [("x", i // 4, i, float(i)) for i in range(12)] + [("y", i // 4, i, -1.0 if i % 4 == 2 else 1.0) for i in range(12) if i % 4]


def test_quantiles_in_one_pass_over_brackets(spark, monkeypatch):
    """Values of large groups, with many copies, that several brackets share; and groups too many to be broadcast."""
    import numpy as np

    monkeypatch.setattr(order_statistics, "SMALL", 500)
    r = np.random.default_rng(3)
    values = {"a": r.integers(0, 9, 3000).astype(float), "b": r.normal(size=3000), "c": r.normal(size=40)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    out = order_statistics.quantiles_of(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.5})
    found = {x["k"]: [x[n] for n in "abcd"] for x in out.collect()}
    for k, vs in values.items():
        assert np.allclose(found[k], np.quantile(vs, [0.25, 0.5, 0.75, 0.5]), rtol=0, atol=1e-12)
    assert "BroadcastHashJoin" in plan(out)
    groups = df.groupBy("k").count()
    assert order_statistics.settled(groups, 2) is groups


def looks(monkeypatch) -> list:
    """The tables that edges are looked for in from here on."""
    from seriesloom.operators import features, grid, scans

    seen, real = [], scans.edges_of
    for module in (scans, features, grid):
        monkeypatch.setattr(module, "edges_of", lambda df, *a: seen.append(df) or real(df, *a), raising=False)
    return seen


def series(spark):
    return spark.createDataFrame([(i % 2, i // 3, i, float(i * 7 % 11)) for i in range(60)], "k int, t int, id int, x double")


def test_bucket_value_is_worked_out_once(spark):
    from pyspark.sql import functions as F
    from seriesloom.operators import scans

    edges = sorted({-3.5, -1.0, 0.0, 0.25, 2.0, 7.0, 9.0, 12.0, 40.0})
    values = [None, -9.0, -3.5, -3.4, 0.0, 0.1, 0.25, 7.0, 11.9, 12.0, 41.0, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in range(len(edges) + 1):
        out = df.select("v", scans.bucket_of(F.cbrt("v"), edges[:n]).alias("b"))
        assert plan(out).count("CBRT") <= 1
        for r in df.select("v", scans.bucket_of(F.col("v"), edges[:n]).alias("b")).collect():
            assert r["b"] == (0 if r["v"] is None else sum(e <= r["v"] or r["v"] != r["v"] for e in edges[:n]))


def test_volatility_features_look_once(spark, monkeypatch):
    from seriesloom.operators import features

    seen = looks(monkeypatch)
    features.volatility_features(series(spark), ["k"], ["t", "id"], "x", 5)
    assert len(seen) == 1


def test_all_features_look_once(spark, monkeypatch):
    from seriesloom.operators import features

    seen = looks(monkeypatch)
    features.all_features(series(spark), ["k"], ["t", "id"], "x", 5, 6)
    assert len(seen) == 1


def test_many_lags_look_once(spark, monkeypatch):
    from seriesloom.operators import windows

    seen = looks(monkeypatch)
    windows.many_lags(series(spark), ["k"], ["t", "id"], "x", [1, 7])
    assert len(seen) == 1


def test_gaussian_smooth_looks_once(spark, monkeypatch):
    from seriesloom.operators import windows

    seen = looks(monkeypatch)
    out = windows.gaussian_smooth(series(spark), ["k"], ["t", "id"], "x", 2.0, 16)
    assert len(seen) == 1
    assert "collect_list" not in plan(out)


def test_volatility_looks_once(spark, monkeypatch):
    from seriesloom.operators import windows

    seen = looks(monkeypatch)
    windows.volatility(series(spark), ["k"], ["t", "id"], "x", 4, 8)
    assert len(seen) == 1


def test_scattered_orders_ties_as_the_sql_does(agree):  # noqa: F811
    r = random.Random(2)
    agree("ano3_scattered", [(i, at(i // 4), 1, "view", round(r.uniform(0, 9) * (40 if i > 150 else 1), 2)) for i in reversed(range(200))])


def test_dominant_periods_look_once(spark, monkeypatch):
    from seriesloom.operators import features

    seen = looks(monkeypatch)
    features.dominant_periods(series(spark), ["k"], ["t", "id"], "x", 2, 9)
    assert len(seen) == 1


def test_resample_filled_looks_at_bare_slots(spark, monkeypatch):
    from seriesloom.operators import grid

    seen = looks(monkeypatch)
    df = spark.createDataFrame([(1, at(0), 2.0), (1, at(5), 4.0)], "k int, ts timestamp_ntz, x double")
    assert sorted(r["m"] for r in grid.resample_filled(df, ["k"], "ts", 3600, {"m": ("x", "mean")}, {}).collect()) == [2.0, 2.4, 2.8, 3.2, 3.6, 4.0]
    assert [d.columns for d in seen] == [["k", "slot"]]


def test_long_texts_are_held_once_a_task(spark, tmp_path):
    """Written out, the result holds a text once a task, not once a row; hot keys are sliced, rows without a text or a key drop out."""
    from pyspark.sql import functions as F

    from seriesloom.operators import joins

    rows = spark.range(6000).select("id", F.when(F.col("id") % 101 > 0, F.col("id") % 60).alias("k"))
    texts = spark.range(50).select(F.col("id").alias("k"), F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(600)), lambda i: F.sha2(F.concat_ws(":", "id", i), 256))).alias("text"), F.when(F.col("id") == 3, 4).otherwise(1).alias("slices"))
    out = joins.join_texts(rows, texts, "k", "text")
    assert sorted(out.collect()) == sorted(rows.join(texts, "k").select(*out.columns).collect())
    out.write.parquet(str(tmp_path / "out"))
    written = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert written < 2 * 53 * 601 * 64  # 50 texts, one of them in four slices; a text a row would be 180 MB


def test_interval_facts_hold_a_text_once(spark, tmp_path):
    """Dates in turn, so that rows of a date do not stand together in the table, against the SQL and by the size of what is written."""
    import duckdb
    from datetime import datetime, timedelta

    import __spark_entry__

    day = lambda i: datetime(2000, 1, 1) + timedelta(i)
    n = 60_000
    spark.createDataFrame([(i, day(i % 9), f"{i * 7919 % 99991}-FACT") for i in range(n)], "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, 1, day(i % 30)) for i in range(600)], "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    wanted = con.sql(__spark_entry__.oracle_sql()["jon8_interval_facts"]).fetchall()
    out = __spark_entry__.queries()["jon8_interval_facts"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(wanted)
    out.write.parquet(str(tmp_path / "out"))
    texts = sum(len(t.encode()) for t in {r[2] for r in wanted})
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2 * texts


def test_texts_that_fill_a_dictionary_never_meet(spark, tmp_path):
    """Two texts of 0.6 MB in one file pass Parquet's dictionary, and from there on each row holds its text; short texts, missing ones and null keys are among them."""
    from pyspark.sql import functions as F

    from seriesloom.operators import joins

    rows = spark.range(1200).select("id", F.when(F.col("id") % 101 > 0, F.col("id") % 60).alias("k"))
    length = F.when(F.col("id") < 14, 9400).otherwise(5)
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), length), lambda i: F.sha2(F.concat_ws(":", "id", i), 256)))
    texts = spark.range(50).select(F.col("id").alias("k"), text.alias("text"), F.when(F.col("id").isin(3, 30), 2).otherwise(1).alias("slices"))
    texts.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    out = joins.join_texts(rows, texts, "k", "text")
    wanted = rows.join(texts, "k").select("id", "k", F.sha2("text", 256).alias("text"))
    assert sorted(out.select("id", "k", F.sha2("text", 256)).collect()) == sorted(wanted.collect())
    met = out.groupBy(F.spark_partition_id()).agg(F.collect_set("k").alias("keys")).collect()
    assert all(len(r["keys"]) == 1 for r in met if min(r["keys"]) < 14)
    out.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1.2 * 15 * 9400 * 64  # 14 long texts, one of them in two slices

"""Operators on literal frames: nulls, ties, empty inputs and errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import safe_divide
from seriesloom.operators import aggregates, edits, filters, joins, projections, relations, scaling, windows
from seriesloom.sources import readers, writers


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_group_filter_is_and_over_dicts_or_inside(spark):
    df = spark.createDataFrame([("A", "NY", 1), ("A", "CA", 2), ("B", "NY", 3), ("B", "TX", 4), ("C", "CA", 5)], "category string, location string, value long")
    assert values(filters.group_filter(df, [{"category": ["A"], "location": ["TX"]}]), "value") == [(1,), (2,), (4,)]
    assert values(filters.group_filter(df, [{"category": ["A", "B"]}, {"location": ["NY"]}]), "value") == [(1,), (3,)]
    assert values(filters.group_filter(df, [{"value": ["3", 4.0, "x", 2.5]}]), "value") == [(3,), (4,)]
    assert values(filters.group_filter(df, [{"unknown": ["A"]}]), "value") == []


def test_merge_repeated_rejects_varying_text(spark):
    rows = [(1, "a", 1.0, "x"), (1, "a", 2.0, "y")]
    df = spark.createDataFrame(rows, "ts long, k string, v double, t string")
    with pytest.raises(Exception, match="differs inside a group"):
        aggregates.merge_repeated(df, "ts", ["k"], "sum", ["v"], ["t"]).collect()
    same = spark.createDataFrame([(1, "a", 1.0, "x"), (1, "a", 2.0, "x"), (2, None, 9.0, "x")], df.schema)
    assert values(aggregates.merge_repeated(same, "ts", ["k"], "mode", ["v"], ["t"]), "ts", "v", "t") == [(1, 1.0, "x")]


def test_basic_statistics_of_short_and_constant_series(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("b", 5.0), ("b", 5.0)], "k string, value double")
    out = {r["k"]: r for r in aggregates.basic_statistics(df, ["k"]).collect()}
    assert (out["a"]["skewness"], out["a"]["std"]) == (0.0, 0.5)
    assert (out["b"]["kurtosis"], out["b"]["std"]) == (0.0, 0.0)


def test_fill_and_interpolate(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 6.0), ("a", 5, None), ("b", 1, None)], "k string, p int, y double")
    assert values(windows.interpolate(df, ["k"], ["p"], "y"), "k", "p", "y_filled") == [("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 4.0), ("a", 4, 6.0), ("a", 5, 6.0), ("b", 1, 0.0)]
    assert values(df.select("k", "p", windows.fill_both_ways("y", ["k"], ["p"], 0.0).alias("f")), "k", "p", "f")[-1] == ("b", 1, 0.0)


def test_windows_of_short_series_and_empty_table(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)], "k string, p int")
    assert windows.sliding_windows(df, ["k"], ["p"], 6, 1).count() == 0
    assert windows.sliding_windows(df, ["k"], ["p"], 5, 3).select("window_idx").distinct().count() == 1
    assert windows.sliding_windows(df.limit(0), ["k"], ["p"], 2, 1).count() == 0


def test_edits(spark):
    df = spark.createDataFrame([(1.0, "x"), (-2.0, "x"), (0.0, "x")], "v double, s string")
    out = [r[0] for r in df.select(edits.perturbed(df, "v", "divide", 0)).collect()]
    assert out[0] == float("inf") and out[1] == float("-inf") and out[2] != out[2]
    with pytest.raises(ValueError, match="not numeric"):
        edits.perturbed(df, "s", "add", 1)
    with pytest.raises(ValueError, match="does not fit"):
        edits.exact(df, "v", "text")
    assert edits.covariate_subsets(["a", "b"], 1) == [(), ("a",), ("b",)]


def test_scalers_round_trip_and_unknown_label(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0)], "k string, value double")
    p = scaling.fit_scaler(df, ["k"], "standard")
    there = scaling.apply_scaler(df, p, ["k"])
    assert values(scaling.apply_scaler(there, p, ["k"], invert=True), "k", "value") == values(df, "k", "value")
    with pytest.raises(Exception, match="no scaler"):
        scaling.apply_scaler(spark.createDataFrame([("z", 1.0)], df.schema), p, ["k"]).collect()


def test_rejections(spark):
    twice = spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(Exception, match="duplicate keys"):
        scaling.reject_duplicates(twice, ["id"]).collect()
    with pytest.raises(ValueError, match="missing columns: b"):
        filters.require_columns(spark.range(1), ["id", "b"])


def test_roles_names_and_division(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a long, b double, c string")
    assert projections.infer_roles(df) == {"continuous": ["a", "b"], "discrete": ["c"]}
    assert projections.unique_names(spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a"))).columns == ["a", "a_1"]
    assert projections.without_generated(df.withColumn("b_lag_2", F.lit(0)), ("time_",)).columns == ["a", "b", "c"]
    assert spark.range(1).select(safe_divide(F.lit(1.0), F.lit(0.0))).first()[0] == 0.0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, ts int, v double")
    writers.save_series(df, str(tmp_path / "s"), ["k"])
    again = spark.createDataFrame([("b", 2, 2.0), ("c", 3, 3.0)], df.schema)
    fresh = writers.save_series(again, str(tmp_path / "s"), ["k"], spark.read.parquet(str(tmp_path / "s")))
    assert values(spark.read.parquet(str(tmp_path / "s")), "k", "v") == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    assert values(fresh, "k") in ([("c",)], [])
    assert writers.save_dataset(df, str(tmp_path / "d.csv"), "ts", "csv").first()["rows"] == 2
    assert readers.read_table(spark, str(tmp_path / "d.csv"), ["k", "v"]).count() == 2
    writers.save_samples(df.withColumn("split", F.lit("train")), str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).where("split = 'train'").count() == 2


def test_stacked_widens(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2.5,)], "x double")
    out = readers.stacked([a, b])
    assert dict(out.dtypes)["x"] == "double" and values(out, "x", "_source_id") == [(1.0, 0), (2.5, 1)]


def test_every_query_vector_gets_its_nearest_beyond_ten_thousand(spark):
    queries = spark.range(10_050).selectExpr("id as q", "array(cast(id as float)) as query")
    corpus = spark.createDataFrame([(i, [float(i * 3000)]) for i in range(5)], "id long, vector array<float>")
    near = relations.nearest_of(queries, corpus).select("q", "id").collect()
    assert sorted(map(tuple, near)) == [(q, min(range(5), key=lambda i: (abs(i * 3000 - q), i))) for q in range(10_050)]
    two = relations.nearest_of(queries.where("q = 4000"), corpus, k=2, size=2)
    assert sorted(map(tuple, two.select("id", "distance").collect())) == [(1, 1000.0), (2, 2000.0)]


def test_every_edit_and_typed_text_is_met(spark):
    windows_ = spark.createDataFrame([(0, 2.0), (1, 4.0)], "window_idx long, v double")
    assert values(edits.edit_grid(windows_, [1.0, 0.5], "v", 2), "new_idx", "v") == [(0, 2.0), (1, 4.0), (2, 1.0), (3, 2.0)]
    wanted = [str(i) for i in range(1005)]
    assert joins.closest_value(wanted, spark.createDataFrame([("7",)], "value string")).count() == 1005
    many = spark.range(24).selectExpr("concat('c', id) as column", "'x' as value").union(spark.createDataFrame([("c3", "y")], "column string, value string"))
    assert edits.filter_combinations(many).count() == 2

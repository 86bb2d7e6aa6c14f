"""Scores at extreme sizes, routing, reports, transfer tasks, inverted files, chosen folders, window spectra and periods against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import evaluation, features, grid, relations
from seriesloom.sources import readers, writers


@pytest.mark.parametrize("scale", [1e-10, 1.0, 1e20])
def test_crps_at_any_size(spark, scale):
    r = random.Random(1)
    members = {k: [r.choice([r.random(), 0.5, 0.25]) * scale for _ in range(n)] for k, n in (("a", 40), ("b", 1), ("c", 7))}
    rows = [(k, v) for k, vs in members.items() for v in vs] + [("a", None), ("gone", None)]
    found = evaluation.crps(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 0.3 * scale).collect()
    wanted = {k: np.mean([abs(v - 0.3 * scale) for v in vs]) - np.mean([abs(v - w) for v in vs for w in vs]) / 2 for k, vs in members.items()}
    assert {r["k"] for r in found} == set(wanted)
    assert all(math.isclose(r["crps"], wanted[r["k"]], rel_tol=1e-9, abs_tol=1e-12 * scale) for r in found)


def test_routes_and_short_series(spark):
    rows = [("season", t, float(t % 4)) for t in range(24)] + [("line", t, 3.0 * t) for t in range(24)] + [("flat", t, 5.0) for t in range(24)] + [("one", 0, 1.0), ("two", 0, 1.0), ("two", 1, 2.0)]
    found = {r["k"]: (r["model"], r["mae"]) for r in evaluation.route(spark.createDataFrame(rows, "k string, t int, x double"), ["k"], ["t"], "x", 4, 4).collect()}
    assert found == {"season": ("seasonal", 0.0), "line": ("drift", 0.0), "flat": ("drift", 0.0)}  # series without a history have no candidate


def test_report_of_all_columns_in_small_chunks(spark):
    r = random.Random(3)
    make = lambda shift, n: [(r.gauss(shift, 1), r.choice([0.0, 1.0, None]), r.choice("abc")) for _ in range(n)]
    a, b = (spark.createDataFrame(x, "x double, y double, z string") for x in (make(0, 150), make(2, 90)))
    whole, small = ({row["column_name"]: row for row in evaluation.report(a, b, ["x", "y"], ["z"], chunk=c).collect()} for c in (1 << 14, 13))
    for name in ("x", "y", "z"):
        assert math.isclose(whole[name]["jsd"], small[name]["jsd"]) and math.isclose(whole[name]["emd"] or 0, small[name]["emd"] or 0, rel_tol=1e-9)
    left, right = (sorted(row["x"] for row in t.collect()) for t in (a, b))
    grid_ = sorted({*left, *right})
    emd = sum(abs(np.searchsorted(left, v, "right") / len(left) - np.searchsorted(right, v, "right") / len(right)) * (w - v) for v, w in zip(grid_, grid_[1:]))
    assert math.isclose(small["x"]["emd"], emd, rel_tol=1e-9) and small["x"]["flagged"] and not small["z"]["flagged"]


def test_logs_are_cut_to_complete_epochs(spark):
    rows = [("a", 0, 1.0), ("a", 1, 0.9), ("a", 2, None), ("b", 0, None), ("c", 0, 0.8), ("c", 1, None), ("c", 2, 0.7)]
    found = evaluation.joined_logs(spark.createDataFrame(rows, "run string, epoch int, loss double"), "run", "epoch", "loss").collect()
    assert sorted((r["run"], r["epoch"], r["epoch_total"]) for r in found) == [("a", 0, 0), ("a", 1, 1), ("c", 0, 1), ("c", 1, 2), ("c", 2, 3)]


def test_months_are_four_or_five_weeks(spark):
    rows = spark.sql("select timestamp_ntz '2023-02-01' as ts, 1 as n union all select timestamp_ntz '2024-02-01', 2 union all select timestamp_ntz '2024-04-01', 3")
    assert {r["n"]: r["count"] for r in grid.upsample(rows, "ts", "month").groupBy("n").count().collect()} == {1: 4, 2: 5, 3: 5}


def entropy_of(x, y, lag, bins):
    """Transferred entropy over the target's entropy, by its definition."""
    from collections import Counter

    code = lambda v: [min(bins - 1, math.floor((z - min(v)) * bins / (max(v) - min(v)))) for z in v]
    x, y = code(x), code(y)
    states = [(y[t], y[t - 1], x[t - lag]) for t in range(max(1, lag), len(y))]
    h = lambda c: -sum(n / len(states) * math.log2(n / len(states)) for n in Counter(c).values())
    return (h([s[:2] for s in states]) - h([s[1] for s in states]) - h(states) + h([s[1:] for s in states])) / h([s[0] for s in states])


def test_transfer_tasks_and_best_lags(spark):
    r = random.Random(5)
    x = [r.random() for _ in range(400)]
    y = [0.0, 0.0, *[x[t - 2] + 0.1 * r.random() for t in range(2, 400)]]
    z = [r.random() for _ in range(399)] + [50.0]  # one value far off leaves few bins that are used twice
    rows = [(s, t, v) for s, vs in (("x", x), ("y", y), ("z", z)) for t, v in enumerate(vs)]
    tasks = relations.transfer_tasks(spark.createDataFrame(rows, "s string, t int, v double"), "s", "t", "v", [1, 2, 5], 6, ["y"], 2).collect()
    series = {"x": x, "y": y, "z": z}
    assert {(r["source"], r["target"]) for r in tasks} == {("x", "y"), ("y", "x"), ("z", "y"), ("y", "z")} and len(tasks) == 12
    for r in tasks:
        assert r["bins"] == (6 if "z" not in (r["source"], r["target"]) else 2)
        assert math.isclose(r["te"], entropy_of(series[r["source"]], series[r["target"]], r["lag"], r["bins"]), abs_tol=1e-9)
    best = {(r["source"], r["target"]): r["lag"] for r in relations.best_lags(spark.createDataFrame(tasks)).collect()}
    assert best["x", "y"] == 2


def test_inverted_file_is_exact_and_its_first_look_nearly(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))
    x[:5] = x[5]  # equal vectors: ties by id
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id long, vector array<double>").repartition(4)
    asked = list(range(0, 3000, 20))
    queries = spark.createDataFrame([(i, (x[i] + 0.1).tolist()) for i in asked], "q long, query array<double>")
    wanted = {q: [int(i) for i in np.lexsort((np.arange(3000), np.sqrt(((x - (x[q] + 0.1)) ** 2).sum(1)).round(12)))[:3]] for q in asked}
    for exact in (True, False):
        found: dict[int, list[int]] = {}
        for r in relations.nearest_in_lists(queries, corpus, 3, relations.fit_lists(corpus, 32, 40), 4, exact, size=100).orderBy("place").collect():
            found.setdefault(r["q"], []).append(r["id"])
        recall = np.mean([len({*found.get(q, [])} & {*wanted[q]}) / 3 for q in asked])
        assert found == wanted if exact else recall >= 0.9
    assert relations.nearest_in_lists(queries, corpus.where("id < 0")).count() == 0


def files_read(spark, df):
    """Rows of a query and how many files its scans opened, from Spark's own metrics."""
    n = df.count()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    metrics = store.executionMetrics(last.executionId())
    nodes = store.planGraph(last.executionId()).allNodes()
    opened = 0
    for i in range(nodes.size()):
        for j in range(nodes.apply(i).metrics().size()):
            m = nodes.apply(i).metrics().apply(j)
            if m.name() == "number of files read" and metrics.contains(m.accumulatorId()) and "series" in nodes.apply(i).desc():
                opened += int(metrics.apply(m.accumulatorId()).replace(",", ""))
    return n, opened


def test_only_the_chosen_series_are_opened(spark, tmp_path):
    long = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 40).alias("series_id"), F.col("id").alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    writers.save_series(long, f"{tmp_path}/data", ["series_id"])
    writers.save_catalog(long, f"{tmp_path}/catalog", "series_id", "ts", "value")
    catalog = spark.read.parquet(f"{tmp_path}/catalog")
    found = readers.chosen_series(spark, f"{tmp_path}/data", catalog, "series_id in ('s1', 's3')", columns=["ts", "value"])
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    n, opened = files_read(spark, found)
    assert n == 200 and 0 < opened <= 6  # two folders of forty, and the catalog's few files
    assert writers.new_series(long, catalog, ["series_id"]).count() == 0


def test_window_spectra(spark):
    r = random.Random(8)
    windows = {i: [round(r.gauss(0, 5), 3) for _ in range(n)] for i, n in enumerate((24, 24, 7, 1))}
    found = features.window_fourier(spark.createDataFrame(list(windows.items()), "i int, v array<double>"), "v", 10).collect()
    for row in found:
        y = np.array(windows[row["i"]])
        c = np.fft.fft(y)[:10] / len(y)
        c = np.round(c.real, 9) + 0.0 + 1j * (np.round(c.imag, 9) + 0.0)
        np.testing.assert_allclose(row["coefficients"], c.real + 1, atol=1e-8)
        wanted = {"mean_magnitude": np.abs(c).mean(), "median_magnitude": np.median(np.abs(c)), "std_magnitude": np.abs(c).std(), "ts_rms": np.sqrt((y**2).mean()), "ts_std": y.std(), "ts_abs_max": np.abs(y).max(), "ts_length": len(y)}
        for name, value in wanted.items():
            assert math.isclose(row[name], value, abs_tol=1e-7), name


def test_periods(spark):
    r = random.Random(9)
    rows = [("p", t, 9 * math.sin(2 * math.pi * t / 12) + 7 * math.sin(2 * math.pi * t / 10) + r.gauss(0, 0.1)) for t in range(120)] + [("noise", t, r.gauss(0, 1)) for t in range(40)] + [("short", 0, 1.0)]
    found = {x["s"]: (x["period"], list(x["periods"])) for x in features.dominant_periods(spark.createDataFrame(rows, "s string, t int, v double"), ["s"], ["t"], "v", 3, 30).collect()}
    assert found["p"] == (12, [12, 10]) and found["short"] == (3, [])


def test_feature_record_of_a_series(spark):
    r = random.Random(10)
    y = [50 + r.gauss(0, 5) for _ in range(60)]
    found = features.all_features(spark.createDataFrame([("a", t, v) for t, v in enumerate(y)], "k string, t int, v double"), ["k"], ["t"], "v", 5).first()
    s = pd.Series(y)
    d = s.diff().abs().dropna().to_numpy()
    clustering = np.mean([np.corrcoef(d[:-k], d[k:])[0, 1] for k in range(1, 21)])
    rolled = [np.std(y[i - 5 : i]) for i in range(5, 60)]
    rest = np.array(y[3:]) - np.convolve(y, np.ones(4) / 4, mode="valid")
    wanted = {"mean": s.mean(), "clustering": clustering, "roll_mean": np.mean(rolled), "roll_std": np.std(rolled), "variance_ratio": rest.var() / np.var(y), "slope": np.polyfit(range(60), y, 1)[0]}
    assert all(math.isclose(found[name], value, rel_tol=1e-6) for name, value in wanted.items())

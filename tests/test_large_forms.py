"""Operators whose plan bounds what a task holds, against plain Python: quantiles, modes, as-of joins, vectors, sums of ensembles."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import aggregates, anomalies, evaluation, features, joins, order_statistics, relations, sampling, scaling, windows
from seriesloom.sources import writers
from seriesloom.streaming import jobs


@pytest.mark.parametrize("small", [5000, 10_000])
def test_quantiles_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(order_statistics, "SMALL", small)
    r = random.Random(3)
    rows = [(k, v) for k in ("a", "b", None) for v in [r.choice([1.0, 2.0, r.gauss(0, 1), 1e9]) for _ in range(5000)]] + [("one", 5.0), ("none", None), *[("few", float(i)) for i in range(7)]]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"low": 0.0, "a": 0.013, "mid": 0.5, "b": 0.977, "high": 1.0}
    found = {x["k"]: x for x in order_statistics.quantiles_of(df, ["k"], "v", shares).collect()}
    assert set(found) == {"a", "b", None, "one", "few"}
    for k, row in found.items():
        own = [v for kk, v in rows if kk == k and v is not None]
        for name, q in shares.items():
            assert row[name] == pytest.approx(np.quantile(own, q), rel=1e-12)
    whole = order_statistics.quantiles_of(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))


def test_modes_and_medians_of_merged_rows(spark):
    df = spark.createDataFrame([(1, "a", v, "t") for v in (3.0, 2.0, 3.0, 2.0, 9.0)] + [(2, "a", None, "t")], "ts long, k string, v double, t string")
    assert [tuple(r) for r in order_statistics.mode_of(df, ["k"], "v", "m").collect()] == [("a", 2.0)]
    for how, wanted in (("mode", 2.0), ("median", 3.0)):
        out = aggregates.merge_repeated(df, "ts", ["k"], how, ["v"], ["t"]).orderBy("ts").collect()
        assert [(x["ts"], x["v"]) for x in out] == [(1, wanted), (2, None)]


def test_robust_scaler_outliers_and_z(spark):
    r = random.Random(4)
    rows = [("s", i, r.gauss(0, 3)) for i in range(400)] + [("s", 400, 60.0)]
    df = spark.createDataFrame(rows, "k string, i long, value double")
    v = [x[2] for x in rows]
    one = scaling.fit_scaler(df, ["k"], "robust").first()
    assert (one["centre"], one["scale"]) == pytest.approx((np.median(v), np.quantile(v, 0.75) - np.quantile(v, 0.25)))
    a, b = np.quantile(v, 0.25), np.quantile(v, 0.75)
    assert features.outliers(df, ["k"], "value", "iqr", 1.5).count() == sum(x < a - 1.5 * (b - a) or x > b + 1.5 * (b - a) for x in v)
    z = anomalies.modified_z(df, ["k"], "value", 3.5).where("i = 400").first()["z"]
    med = np.median(v)
    assert z == pytest.approx(0.6745 * (60.0 - med) / np.median(np.abs(np.array(v) - med)))


@pytest.mark.parametrize("keys", [("k",), ()])
def test_as_of_over_buckets(spark, keys):
    r = random.Random(5)
    at = lambda: 86400 * r.randint(0, 9) + 3600 * r.randint(0, 23)
    left, right = [(i, r.choice("ab"), at()) for i in range(200)], [(r.choice("ab"), t, t + 0.5) for t in sorted({at() for _ in range(15)})]
    stamp = lambda d: d.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    a = stamp(spark.createDataFrame([*left, (200, "a", None)], "id long, k string, s long"))
    b = stamp(spark.createDataFrame(right, "k string, s long, v double")).drop("s")
    for forward in (False, True):
        found = {x["id"]: x["v"] for x in joins.as_of(a, b, "ts", ["v"], keys, forward=forward).collect()}
        assert found.pop(200) is None
        for i, k, t in left:
            same = [(s, v) for kk, s, v in right if (not keys or kk == k) and (s >= t if forward else s <= t)]
            assert found[i] == (min(same) if forward else max(same))[1] if same else found[i] is None


def test_filling_from_behind(spark):
    rows = [(k, i, v) for k in "ab" for i, v in enumerate([None, 1.0, None, None, 4.0, None])]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    out = df.withColumn("f", windows.fill_both_ways("v", ["k"], ["i"], 0.0)).where("k = 'a'").orderBy("i")
    assert [x["f"] for x in out.collect()] == [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]
    out = windows.interpolate(df, ["k"], ["i"], "v").where("k = 'b'").orderBy("i")
    assert [x["v_filled"] for x in out.collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_ensemble_score(spark):
    x = [3.0, 1.5, 1.5, 9.25, 40.0]
    df = spark.createDataFrame([("e", v) for v in x] + [("e", None)], "k string, v double")
    wanted = np.mean(np.abs(np.array(x) - 7.0)) - np.abs(np.subtract.outer(x, x)).mean() / 2
    assert evaluation.crps(df, ["k"], "v", 7.0).first()["crps"] == pytest.approx(wanted)


def test_all_metrics_of_nearest_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, (60, 5)).astype(float)
    rows = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "id long, vector array<float>").repartition(3)
    asked = rows.where("id % 7 = 0").selectExpr("id as q", "vector as query")
    found = relations.nearest_by_metrics(asked, rows, relations.METRICS, 3, size=4, apart=True).collect()
    for metric in relations.METRICS:
        d = relations.block_distances(v, v, metric)
        for q in range(0, 60, 7):
            got = [x["id"] for x in sorted((x for x in found if x["metric"] == metric and x["q"] == q), key=lambda x: x["place"])]
            assert got == sorted((i for i in range(60) if i != q), key=lambda i: (d[q, i], i))[:3]
    means = {(x["ci"], x["cj"]): x["mean"] for x in relations.grouped_distances(asked.selectExpr("q % 2 as ci", "query"), rows.selectExpr("id % 3 as cj", "vector"), size=5).collect()}
    e = relations.block_distances(v, v, "euclidean")
    assert means[(1, 2)] == pytest.approx(e[[q for q in range(0, 60, 7) if q % 2 == 1]][:, [i for i in range(60) if i % 3 == 2]].mean())


def test_granger_pca_and_kmeans_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=80)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + rng.normal(size=80) * 0.3
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k string, pos long, x double, v double")
    score = relations.granger(df, ["k"], "x", "v", "pos", 2).first()["score"]
    rows = np.arange(2, 80)
    own = np.stack([np.ones(78), y[rows - 1], y[rows - 2]], 1)
    both = np.concatenate([own, np.stack([x[rows - 1], x[rows - 2]], 1)], 1)
    rss = [((y[rows] - m @ np.linalg.lstsq(m, y[rows], rcond=None)[0]) ** 2).sum() for m in (own, both)]
    assert score == pytest.approx(1 - rss[1] / rss[0], abs=1e-9) and score > 0.5
    v = rng.normal(size=(50, 4)) * [5, 3, 1, 0.2]
    vectors = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "id long, vector array<double>")
    got = np.array([r["pca"] for r in relations.principal_components(vectors, "vector", 2).orderBy("id").collect()])
    centred = v - v.mean(axis=0)
    wanted = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.abs(got) == pytest.approx(np.abs(wanted), abs=1e-8)
    blobs = np.concatenate([rng.normal(size=(20, 2)) + c for c in ([0, 0], [50, 0], [0, 50])])
    clusters = relations.kmeans(spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(blobs)], "id long, vector array<double>"), "vector", 3).orderBy("id").collect()
    names = [r["cluster"] for r in clusters]
    assert len(set(names)) == 3 and all(len(set(names[i : i + 20])) == 1 for i in (0, 20, 40))


def test_text_ranks_and_codes(spark):
    words = spark.createDataFrame([(w,) for w in ("b", "ab", "aab", "", "b", None, "\u00e9", "aa")], "w string")
    ranks = {x["w"]: x["r"] for x in order_statistics.dense_rank_of_text(words, "w", "r").collect()}
    assert ranks == {w: i for i, w in enumerate(sorted({"b", "ab", "aab", "", "\u00e9", "aa"}), 1)}
    df = spark.createDataFrame([("z", 5), ("q", 1), ("z", 0), (None, 2), ("m", 9)], "w string, i long")
    assert {x["w"]: x["w_code"] for x in scaling.codes_by_appearance(df, "w", "i").collect()} == {"z": 0, "q": 1, "m": 2, None: -1}


def test_too_many_origins_are_an_error(spark):
    ends = spark.sql("select timestamp_ntz'2024-01-01' as low, timestamp_ntz'2024-03-01' as high")
    assert sampling.forecast_windows(ends, "low", "high", 7).count() == 10
    with pytest.raises(Exception, match="more than 5"):
        sampling.forecast_windows(ends, "low", "high", 7, 5).collect()


def test_batches_and_saved_results(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 2}", 200 + 150 * (i % 3), 0.1 * i) for i in range(9)], "call_id long, user string, code int, seconds double")
    calls = rows.withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).withColumn("endpoint", F.lit("forecast"))
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_batches(stream, writers.usage_rows, str(tmp_path / "raw"), str(tmp_path / "check"))
    assert sorted((x["call_id"], x["status"]) for x in out.collect()) == [(i, ["success", "success", "failed"][i % 3]) for i in range(9)]
    writers.append_usage(calls, str(tmp_path / "table"))
    writers.append_usage(calls, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 18
    for kind in ("csv", "parquet"):
        writers.save_results(rows, str(tmp_path / kind), kind)
        assert sorted(writers.load_results(spark, str(tmp_path / kind), rows.schema, kind).collect()) == sorted(rows.collect())

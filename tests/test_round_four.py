"""Queries against their SQL on rows that the given tables of the smallest size do not have, and operators in small blocks."""

from __future__ import annotations

import math

import pytest

from seriesloom.plans import registry


@pytest.fixture
def agree(spark, tmp_path):
    """A function that holds a query against its SQL over events given as (event_id, ts, user_id, event_type, value); repr tells -0.0 from 0.0."""
    import duckdb

    def check(name, events):
        kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
        path = f"{tmp_path}/events.parquet"
        spark.createDataFrame([(*e, "{}") for e in events], kind).coalesce(1).write.parquet(path)
        found = registry.QUERIES[name](spark, str(tmp_path)).collect()
        con = duckdb.connect()
        con.execute(f"create view events as select * from read_parquet('{path}/*.parquet')")
        cursor = con.execute(registry.SQL[name])
        columns = [c[0] for c in cursor.description]
        wanted = sorted(map(repr, map(tuple, cursor.fetchall())))
        assert sorted(repr(tuple(r[c] for c in columns)) for r in found) == wanted
        return found

    return check


def at(hours):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(hours=hours)


def test_zero_over_zero_as_the_sql_has_it(agree):
    found = agree("edt1_perturbed", [(i, at(i), 1, "view", v) for i, v in enumerate([0.0, 2.5, 7.0])])
    assert all(r["over_zero"] == math.inf for r in found)


def test_over_zero_is_an_infinity_in_every_row(agree):
    """Negative, missing and not finite values, too, as the SQL has it."""
    values = [None, -2.5, -0.0, 0.0, 3.0, math.nan, math.inf, -math.inf, 5e-324, -1e308]
    found = agree("edt1_perturbed", [(i, at(i), 1, "view", v) for i, v in enumerate(values)])
    assert all(r["over_zero"] == math.inf for r in found)


def test_metrics_count_zero_actuals_as_the_sql_does(agree):
    users = {1: [4.0, 6.0, 0.0, 5.0], 2: [2.0, 2.0, 1.0, 4.0], 3: [3.0, 1.0, 2.0]}
    rows = [(u, i, v) for u, values in users.items() for i, v in enumerate(values)]
    found = agree("evl2_forecast_metrics", [(n, at(i if i < 2 else 24 * 22 + i), u, "view", v) for n, (u, i, v) in enumerate(rows)])
    assert {r["user_id"]: r["mape"] == math.inf for r in found} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_mean_in_time_reads_a_row_as_often_however_many_see_it(spark, buckets):
    """Many rows of few times, a span of the whole series, and null times and values, against a plain mean; the plan has no frame that is read again for each row."""
    import random

    from seriesloom.operators import windows

    r = random.Random(4)
    rows = [(i, r.choice("ab"), at(r.choice([0, 1, 2.5, 7, 7, 7, 30])) if i % 17 else None, None if i % 5 == 0 else round(r.uniform(-9, 9), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp_ntz, v double")
    for hours in (1, 6, 1000):
        out = windows.rolling_mean_in_time(df, ["k"], "ts", "v", hours * 3600, buckets)
        assert "specifiedwindowframe(RangeFrame, -" not in out._jdf.queryExecution().toString()
        found = {x["i"]: x["v_mean"] for x in out.collect()}
        assert len(found) == len(rows)
        for i, k, t, _ in rows:
            seen = [v for _, other, u, v in rows if t and u and other == k and v is not None and 0 <= (t - u).total_seconds() < hours * 3600]
            assert found[i] is None if not seen else math.isclose(found[i], sum(seen) / len(seen), rel_tol=1e-9, abs_tol=1e-12)


def test_lists_meet_in_full_blocks(spark, monkeypatch):
    """Rows next to each other go to many lists; the blocks of a list are full all the same, and nothing is lost among copies."""
    import numpy as np

    from seriesloom.operators import relations

    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(1500, 4)), 1)
    x[700:760] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(8)
    made = []
    deal = relations._list_blocks
    monkeypatch.setattr(relations, "_list_blocks", lambda *a: made.append(deal(*a)) or made[-1])
    asked = df.where("id % 20 = 0").selectExpr("id as q", "vector as query")
    found = {(f["q"], f["place"]): f["id"] for f in relations.nearest_in_lists(asked, df.where("id % 20 <> 0"), 3).collect()}
    assert made[0].count() <= 64 and made[1].count() <= 64  # a block a list: 1,425 vectors, 75 queries
    others = [i for i in range(1500) if i % 20]
    for q in range(0, 1500, 20):
        d = np.sqrt(((x[others] - x[q]) ** 2).sum(axis=1))
        assert [found[q, p] for p in (1, 2, 3)] == [others[i] for i in np.lexsort((others, d))[:3]]


@pytest.mark.parametrize("size", [7, 50, 64, 1000])
def test_tiles_are_worked_out_once_a_pair(spark, size):
    """Every number of blocks, copies that tie, and both metrics with a product in them, against all pairs; half of the tiles of before."""
    import numpy as np

    from seriesloom.operators import relations

    r = np.random.default_rng(6)
    x, y = np.round(r.normal(size=(130, 4)), 1), r.normal(size=(130, 3)) * 50
    x[20:40], y[20:40] = x[5], y[5]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(130)], "id long, p array<double>, q array<double>")
    out = relations.tiled_relations(df, "id", [("p", "cosine", 0.7), ("q", "euclidean", 0.3)], 3, size=size)
    found = {(f["a"], f["place"]): (f["b"], f["score"]) for f in out.collect()}
    score = np.round(0.7 * (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :] - 0.3 * np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)), 12)
    for a in range(130):
        others = [b for b in range(130) if b != a]
        best = sorted(others, key=lambda b: (-score[a, b], b))[:3]
        assert [found[a, p][0] for p in (1, 2, 3)] == best
        assert all(math.isclose(found[a, p][1], score[a, b], abs_tol=2e-12) for p, b in zip((1, 2, 3), best))
    assert len(found) == 390


def test_vectors_keep_the_sign_of_what_rounds_to_zero(agree):
    """A slope of -0.00003 is -0.0 in the SQL's array."""
    found = agree("fea13_fixed_vector", [(i, at(i), 1, "view", v) for i, v in enumerate([5.0, 5.00001, 5.0, 4.9999, 5.0, 4.9999])])
    assert any(x == 0 and math.copysign(1, x) < 0 for x in found[0]["vector"])


def test_coefficients_keep_the_sign_of_what_rounds_to_zero(agree):
    found = agree("fea9_window_fourier", [(i, at(i), 1, "view", -1.000002) for i in range(24)])
    assert math.copysign(1, found[0]["coefficients"][0]) < 0

"""Every registered query with SQL against DuckDB on the smallest tables; the others must give rows."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from seriesloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


def text(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if type(value).__name__ in ("int", "int64", "int32", "float", "float64", "float32", "Decimal"):
        return repr(round(float(value), 9) + 0.0)
    return str(value.tolist() if hasattr(value, "tolist") else value)


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.SQL:
        assert len(found)
        return
    wanted = duck.sql(registry.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)

"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from webinsight.plans import load
from webinsight.sources.adapters import BASE

from .conftest import SF

REGISTRY = load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in BASE:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return None if v is None else str(float(v)) if type(v).__name__ == "Decimal" else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_oracle(spark, db, name):
    df = REGISTRY.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    want = db.execute(REGISTRY.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, want.fetchall())


def test_queries_without_sql_have_brute_force():
    from . import test_brute_force

    checked = {n.removeprefix("test_") for n in vars(test_brute_force) if n.startswith("test_")}
    assert set(REGISTRY.QUERIES) - set(REGISTRY.ORACLES) <= checked

"""The registered SQL gives the operators' rows."""

import duckdb
import pytest

from webinsight.llm import registry

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert plain(got.select(names).collect()) == plain(want.fetchall())

"""Every query of the subpackage on the smallest tables; those with an SQL twin give its rows."""

import os

import pytest

from lexspark.llm import queries

DATA = os.environ.get("LEXSPARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_without_repeats(spark, name):
    rows = [repr(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, DATA).collect()]
    assert name.startswith("p9_mix") or len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[: -len('.parquet')]} as select * from '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    rel = c.sql(queries.SQL[name])
    assert {tuple(r[x] for x in rel.columns) for r in df.collect()} == set(rel.fetchall())

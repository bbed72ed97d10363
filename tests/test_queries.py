"""Every core query that SQL can express gives the same rows as its SQL twin on the smallest tables."""

import math
import os

import pytest

from lexspark.plans import catalog

DATA = os.environ.get("LEXSPARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f[: -len('.parquet')]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.columns
    df.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["cd", "pos", "val"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

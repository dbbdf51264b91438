"""Every query with SQL returns the rows DuckDB returns; every query runs."""

import decimal
import math
import os

import duckdb
import pytest

from gradeloom.plans import catalog

DATA = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(names).collect()), key=repr)
    result = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0

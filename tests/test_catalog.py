"""Every query with a DuckDB twin gives its rows."""

import duckdb
import pytest

import __spark_entry__ as driver
from popweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    a = catalog.QUERIES[name](spark, DATA).toPandas()
    b = duck.sql(catalog.SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if a[c].dtype.kind == "f":
            same |= (a[c].astype(float) - b[c].astype(float)).abs() <= 1e-4 * (1 + b[c].astype(float).abs())
        assert same.all(), (c, a[~same].head(), b[~same].head())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())

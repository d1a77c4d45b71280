"""Every registered query against its oracle SQL, and the shape of the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in sorted(os.listdir(SF))] if os.path.isdir(SF) else []
QUERIES, ORACLE = registered.queries(), registered.oracle_sql()

pytestmark = pytest.mark.skipif(not TABLES, reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in rows)


def test_every_query_of_the_catalog_has_an_oracle():
    catalog = {name for module in registered.CATALOG for name in module.QUERIES}
    assert catalog <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(name for module in registered.CATALOG for name in module.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).toPandas()
    expected = duck.execute(ORACLE[name]).df()
    assert sorted(expected.columns) == columns
    left = canonical(got.itertuples(index=False, name=None))
    right = canonical(expected[columns].itertuples(index=False, name=None))
    assert len(left) > 0
    assert left == right


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["section", "company", "title", "url", "keywords"] and df.count() > 0

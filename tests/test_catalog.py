"""Every core query on the smallest tables; those with SQL give the same rows as DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from spanwise import catalog

TABLES = os.environ.get("SPANWISE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(TABLES):
        p = os.path.join(TABLES, t)
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canon(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        df[k] = df[k].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else f"{v:.6f}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, TABLES).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).df()
        pd.testing.assert_frame_equal(canon(got), canon(want))


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)

"""Every query with SQL gives what the SQL gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from codeweft.plans import catalog

D = "/root/testdata/sf0.001"


def plain(v):
    return "" if v is None or v != v else str(int(v)) if isinstance(v, bool) else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{D}/{t}'")
    got = entry.queries()[name](spark, D)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())

"""Every query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tabulant.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = con.execute(ORACLE_SQL[name])
    order = [d[0] for d in res.description]
    assert sorted(order) == cols
    want = [tuple(plain(r[order.index(c)]) for c in cols) for r in res.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry(spark):
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

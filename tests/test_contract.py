"""Every query of the entry file runs on the smallest tables; those with SQL match it."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
QUERIES = {k: v for k, v in entry.queries().items() if not v.__module__.startswith("veldt.llm")}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 4))
    return str(v)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        r = con.sql(sql)
        at = [list(r.columns).index(c) for c in df.columns]
        assert Counter(tuple(map(norm, x)) for x in rows) == Counter(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

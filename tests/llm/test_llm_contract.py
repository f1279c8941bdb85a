"""Every llm query runs on the smallest tables; those with SQL match it."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from veldt.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    if sql := entry.oracle_sql().get(name):
        con = duckdb.connect()
        for f in os.listdir(D):
            con.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")
        r = con.sql(sql)
        at = [list(r.columns).index(c) for c in df.columns]
        assert Counter(tuple(map(str, x)) for x in rows) == Counter(tuple(str(x[i]) for i in at) for x in r.fetchall())

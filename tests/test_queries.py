"""Every registered query next to its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, norm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Slow to start and covered by tests of their own.
SKIP = {"m03_subtypes", "m05_hold_one_session_out", "k04_hour_buckets", "k05_anomaly_table"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)

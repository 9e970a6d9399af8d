"""Every named query with SQL gives the same rows in DuckDB."""
import os

import duckdb
import pytest

from sitewright.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "events documents pages nation".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    return str(round(float(v), 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    got = duck.execute(Q.SQL[name])
    names = [d[0] for d in got.description]
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in got.fetchall())
    assert sorted(names) == columns
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables")
@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0

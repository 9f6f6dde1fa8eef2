"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import os

import duckdb
import pytest

from siteweave.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(value):
    if value is None or value != value:
        return "null"
    return f"{round(float(value), 5) + 0.0:.5f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert mine
        return
    cursor = database.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs

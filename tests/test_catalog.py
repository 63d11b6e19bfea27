"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from tessera.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(([plain(r[i]) for i in at] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
    else:  # where SQL finds nothing (months of 200 rows need a larger table), so must the query
        cur = con.execute(catalog.ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert ordered(rows, df.columns) == ordered(cur.fetchall(), columns)

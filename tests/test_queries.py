"""Every registered query on the smallest test tables against its SQL twin."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import TABLES, Counter, duckdb, plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert order == sorted(cols)
    want = cur.fetchall()
    at = [cols.index(c) for c in order]
    assert Counter(tuple(plain(r[c]) for c in order) for r in rows) == Counter(tuple(plain(w[i]) for i in at) for w in want)


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

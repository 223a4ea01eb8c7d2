import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    want = db.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted((str(tuple(r[c] for c in cols)) for r in df.collect())) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

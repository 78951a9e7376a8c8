import duckdb
import pytest

import __spark_entry__ as entry
from glossmill import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


def test_contract(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())

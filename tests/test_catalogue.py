import duckdb
import pytest

import __spark_entry__
from tierloom.plans import catalogue, more, wider  # noqa: F401  the others add queries to the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    rows = ours.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    theirs = duck.sql(catalogue.ORACLES[name])
    assert sorted(theirs.columns) == sorted(ours.columns)
    order = [theirs.columns.index(c) for c in ours.columns]
    key = lambda r: tuple(map(str, map(plain, r)))
    assert sorted(map(key, rows)) == sorted(key([r[i] for i in order]) for r in theirs.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

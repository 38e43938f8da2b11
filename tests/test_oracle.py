"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_as_sql(spark, db, name):
    mine = __spark_entry__.queries()[name](spark, SF)
    theirs = db.execute(__spark_entry__.oracle_sql()[name])
    named = [c[0] for c in theirs.description]
    assert sorted(named) == sorted(mine.columns)
    a = sorted((tuple(plain(r[c]) for c in named) for r in mine.collect()), key=str)
    b = sorted((tuple(map(plain, r)) for r in theirs.fetchall()), key=str)
    assert a == b


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0

"""Every query with SQL against DuckDB on the same tables, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(flat(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, D)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got == plain(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

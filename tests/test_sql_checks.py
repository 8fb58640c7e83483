"""Every registered query against its SQL in another engine, on the smallest data."""

import math
import os

import duckdb
import pytest

from wicketlake.plans import ENTRIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(round(float(value), 6) + 0.0)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", [k for k, e in ENTRIES.items() if e.sql])
def test_same_rows(spark, other, key):
    mine = ENTRIES[key].build(spark, SF_DIR)
    theirs = other.execute(ENTRIES[key].sql)
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert rows_of(mine.columns, [tuple(r) for r in mine.collect()]) == rows_of(columns, theirs.fetchall())


@pytest.mark.parametrize("key", [k for k, e in ENTRIES.items() if not e.sql])
def test_gives_rows(spark, key):
    assert ENTRIES[key].build(spark, SF_DIR).limit(1).count() == 1

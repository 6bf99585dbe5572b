"""Every query against its SQL on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from normwerk.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, map(tuple, df.collect()))
    if name in registry.oracle_sql():
        want = con.sql(registry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns) and got == table(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered core query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def both(spark, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, DATA)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    return sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr), sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)


def core():
    from termloom.plans import catalogue

    return sorted(catalogue.QUERIES)


@pytest.mark.parametrize("name", core())
def test_core_query(spark, name):
    from termloom.plans import catalogue

    if name not in catalogue.ORACLES:
        assert catalogue.QUERIES[name](spark, DATA).count() > 0
        return
    got, want = both(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

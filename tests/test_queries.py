"""Each registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tamarack.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    if name not in catalogue.SQL:
        assert got
        return
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    assert got == plain(rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_is_registered(spark):
    assert catalogue.FLAGSHIP in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_cross_join_in_the_queue(spark):
    plan = catalogue.QUERIES["queue_composite"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_what_is_asked(spark):
    plan = catalogue.QUERIES["latest_per_key"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan



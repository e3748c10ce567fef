"""Registered queries against their SQL, on the smallest data set; exports and the entry point."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tarifflake.sources.bindings import TABLES, Library
from tarifflake.sources.exports import suppliers, write_bundle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not here")
SOME = ["c7a_live_rates", "a08_trip_totals", "c05_dated_rate_load", "w10_renumber_days", "a20_compare_price_grids", "j12_rate_changes", "st2_daily_usage_stream"]


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry_point.queries()[name](spark, SF)
    cur = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want and got


def test_registry():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 150


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1


def test_bundle(spark, tmp_path):
    lib = Library(spark, SF)
    write_bundle({"suppliers": suppliers(lib.b_supplier)}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/suppliers").count() == 10
    assert spark.read.parquet(f"{tmp_path}/parquet/suppliers").columns[0] == "supplier"


def test_hot_keys_are_limited_before_the_shuffle(spark):
    plan = entry_point.queries()["c7a_live_rates"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

"""Every query that has SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from corpusloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v or ("" if v == "" else None)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(plain(v) for v in r) for r in found), key=repr)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())

"""Each query against the same statement on another engine, and none without rows at the smallest size."""

import math

import duckdb
import pytest

from residua import catalog
from residua.plans.relations import TABLES, relation

SF, SMALLEST = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not hasattr(v, "__float__"):
        return str(v)
    return f"{float(v) + 0.0:.9g}"


@pytest.mark.parametrize("name", catalog.RELATIONAL)
def test_equals_the_other_engine(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*want.columns).collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_none_is_empty_at_the_smallest_size(spark, name):
    assert catalog.queries()[name](spark, SMALLEST).limit(1).count() == 1


def test_every_query_is_a_step():
    assert catalog.unknown() == [] and set(catalog.oracle_sql()) <= set(catalog.queries())


def test_own_frames_replace_tables(spark):
    days = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("b", 4.0)], "event_type string, value double")
    got = {r.event_type: (r.n, r.value) for r in relation(spark, SF, "event_props", events=days).collect()}
    assert got == {"a": (2, 3.5), "b": (1, 4.0)}

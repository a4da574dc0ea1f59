"""Registered queries against their SQL. Set COUNTERSIGN_ALL=1 to run every one of them."""
import datetime
import os

import duckdb
import pytest

from countersign.workload.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ("w1_assign_sequence", "m3_signoff_decide", "j07_find_match", "r1_route", "c07_sweep", "a07_anchor_rollup", "w7_verify_hash_chain", "j13_edit_diff")
NAMES = sorted(ORACLES) if os.environ.get("COUNTERSIGN_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = {c: i for i, c in enumerate(rel.columns)}
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in rel.fetchall())

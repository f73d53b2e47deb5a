"""Every registered query against its SQL over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from roadpulse.checks.oracle import build
from roadpulse.checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order))
    return sorted(out)


def test_every_query_has_sql():
    assert set(build()) == set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    got = contract.queries()[name](spark, SF)
    want = tables.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(want.fetchall(), cols)


def test_entry(spark):
    assert contract.entry(spark).count() > 0

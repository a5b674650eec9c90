"""Every query with an oracle, against DuckDB on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

import stanchion.plans.detection  # noqa: F401
import stanchion.plans.events  # noqa: F401
import stanchion.plans.files  # noqa: F401
import stanchion.plans.streams  # noqa: F401
from stanchion.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: list(v) if isinstance(v, (list, tuple)) else float(v) if isinstance(v, Decimal) else v
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

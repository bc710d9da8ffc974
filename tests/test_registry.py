"""Every registered query runs; those with an oracle match DuckDB (sf0.001)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from mercata.sources.tables import TEST_TABLES

from conftest import SF_ORACLE, SF_SMALL

from mercata.plans.oracle import oracle_sql
from mercata.plans.registry import QUERIES

ORACLES = oracle_sql()
# Thresholds on orders or users per group fit sf0.01; smaller data would leave nothing.
AT_ORACLE_SIZE = {n for n in QUERIES if n.startswith(("delay_by_", "top_spender_"))}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return f if math.isinf(f) else float(f"{f:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for sf in (SF_SMALL, SF_ORACLE):
        out[sf] = duckdb.connect()
        for t in TEST_TABLES:
            out[sf].sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return out


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() >= 0 and df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLES) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, ducks, name):
    sf = SF_ORACLE if name in AT_ORACLE_SIZE else SF_SMALL
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, plan
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name not in ORACLES:
        return
    rel = ducks[sf].sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = sorted((tuple(_norm(r[c]) for c in cols) for r in (dict(zip(rel.columns, t)) for t in rel.fetchall())),
                  key=repr)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in rows), key=repr)
    assert got == want

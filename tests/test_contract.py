"""Every registered query against its SQL equivalent, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from labelloom.plans import catalog, oracles

TABLES = "documents labels conversations pages embeddings benchmark".split()
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small_dir}/{name}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(oracles.oracle_sql()) == set(NAMES)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def order(row):
    return [(v is not None, round(v, 3) if isinstance(v, float) else v) if v is not None else (False, 0) for v in row]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small_dir, duck, name):
    df = contract.queries()[name](spark, small_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order)
    result = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in result.fetchall()), key=order)
    assert len(ours) == len(theirs) and len(ours) > 0
    assert all(same(a, b) for x, y in zip(ours, theirs) for a, b in zip(x, y))


def test_entry(spark, small_dir):
    rows = contract.entry(spark).collect()
    assert [r["class"] for r in rows] == [0, 1, 2]

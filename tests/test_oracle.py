"""Every registered query against its SQL oracle (DuckDB) on the smallest driver tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows_of(cols, res.fetchall())


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(E.queries())


def test_entry_smoke(spark, con):
    df = E.entry(spark)
    want = con.execute(ORACLE["recommendations"]).fetchall()
    assert df.count() == len(want) > 1000 and "intake_session_id" in df.columns

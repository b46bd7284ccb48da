"""The registered queries against their DuckDB twins on the smallest scale,
plus the driver contract."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SQL = E.oracle_sql()
HEAVY = {"loan_study", "loan_validation", "purchase_validation", "repay_decision", "feature_ranking", "feature_lists"}


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert df.columns == ["product_id", "product_name", "quantity"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(SQL) - HEAVY))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0

"""Every exact query against its DuckDB oracle on sf0.001 (layer 1 of the test plan)."""

import pytest

import __spark_entry__ as entry
from churnlens.plans import oracle
from tools.oracle_check import digest

SQL = oracle.SQL
NAMES = sorted(SQL)


def test_every_query_has_a_callable():
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert df.columns[:2] == ["Contract", "n"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    from conftest import SF_SMALL
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    c1, n1, h1, r1 = digest(got)
    c2, n2, h2, r2 = digest(want)
    assert c1 == c2
    assert n1 == n2
    assert h1 == h2, (sorted(set(r1) - set(r2))[:3], sorted(set(r2) - set(r1))[:3])

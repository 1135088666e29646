"""Every query with an oracle equals its DuckDB statement at sf0.001
(row count, column names and types, order-insensitive values)."""

import pytest

import __spark_entry__ as entry
from tillroll.oracle import oracle_statements
from tillroll.plans.catalog import QUERIES
from oracle_check import compare, duck_connect, type_mismatches

SMALL = "/root/testdata/sf0.001"
ORACLE = oracle_statements()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    ok, ns, nd, detail = compare(df, con, ORACLE[name])
    assert ok, detail
    assert not type_mismatches(df, con, ORACLE[name])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 100
    assert df.columns == ["username", "name", "action_type", "action_label", "details", "event_time"]

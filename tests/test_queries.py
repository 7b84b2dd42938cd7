"""Every named query against its check SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, folder, name):
    ok, message = compare(QUERIES[name](spark, folder), con, ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"boosted_model_scores"}))
def test_query_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 5 and "expected_rupees" in out.columns

"""Every query with SQL gives the rows of its SQL on the smallest tables; the others give rows of a stable schema."""

import os
from importlib import import_module

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
CORE = {n: (q, m.SQL.get(n)) for m in map(import_module, entry._CORE) for n, q in m.QUERIES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CORE.items() if sql])
def test_query_equals_sql(spark, con, name):
    query, sql = CORE[name]
    assert difference(spark, con, query, sql, SF) == ""


@pytest.mark.parametrize("name", [n for n, (_, sql) in CORE.items() if not sql])
def test_query_runs(spark, name):
    """What these give is held by literal cases (fondaco.plans.fixtures) and in test_functions."""
    df = CORE[name][0](spark, SF)
    assert df.columns and df.count() > 0 and df.distinct().count() > 1


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_can_be_listed_without_a_session():
    assert set(entry.oracle_sql()) <= set(entry.queries())

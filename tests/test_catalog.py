"""Queries with SQL give the same rows in both engines on the smallest tables.

The headline queries run by default; CATALOG_TESTS=all runs every one (about five minutes more).
"""

import os

import pytest

from bench import HEADLINE
from catalog import ORACLES, QUERIES
from catalog.check import compare, connect

SF = "/root/testdata/sf0.001"
PICKED = sorted(ORACLES if os.environ.get("CATALOG_TESTS") == "all" else set(ORACLES) & set(HEADLINE))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", PICKED)
def test_same_rows_as_sql(spark, con, name):
    state, note = compare(spark, con, SF, name)
    assert state == "ok", note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert QUERIES.keys() <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_every_operator_is_covered():
    from catalog.coverage import functions, queries, survey_ids

    where, asked = functions(), queries()
    assert [i for i in survey_ids() if i not in where or i not in asked] == []
    assert where["F1"] == ["operators.sampling.stratified_take"]
    assert all("performance" in w or "weighted" in w for w in where["A3"])

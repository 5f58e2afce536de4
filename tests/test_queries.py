"""Every registered query against its SQL on the same tables, and the entry point."""

import os

import pytest

import __spark_entry__ as contract
from crosstally.plans.registry import QUERIES
from verification import check
from verification.oracles import ORACLES

#: At this size no account may have been inactive for a year, and no two sites share a number.
MAY_BE_EMPTY = {"q7_inactive"}
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    problem = check.compare(spark, SF, name)
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.reconStatus for r in rows} <= {"matched", "variance", "missing_mfc", "missing_driven"}
    assert sum(r.rows for r in rows) > 0

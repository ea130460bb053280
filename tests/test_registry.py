"""Every registered query runs on the smallest sample and equals its SQL."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not present")

# No date on which all daily series are present at the smallest scale.
NEEDS_MORE_DATA = {"m4_cv_choice", "m9_fit_forest", "m10_fit_boosted", "m10_trees_as_table", "m13_own_estimator"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    if name in NEEDS_MORE_DATA and SF_DIR.endswith("sf0.001"):
        pytest.skip("too few complete days at this scale")
    df = queries()[name](spark, SF_DIR)
    sql = oracle_sql().get(name)
    problem = compare(df, con, sql) if sql else None if len(df.collect()) else "no rows"
    assert problem is None, problem


def test_entry(spark):
    assert len(entry(spark).collect()) > 0

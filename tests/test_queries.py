"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest
from oracle import connect, difference

from wideloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# Boosting and cross-validation take minutes here; test_models.py runs them with fewer rounds.
SLOW = {"grid_search", "stacked_ensemble", "train_gbt", "train_gbt_regressor"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_difference_is_seen(spark, con):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert difference(df, con, "SELECT 1 AS a, 2.0 AS b") is None
    assert difference(df, con, "SELECT 1 AS a, 2.1 AS b")
    assert difference(df, con, "SELECT 1 AS a, 2.0 AS c")
    assert difference(df, con, "SELECT 1 AS a, 2.0 AS b UNION ALL SELECT 1, 2.0")

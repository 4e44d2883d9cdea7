"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

# Eleven coefficients from eight training rows: no unique solution to compare.
UNDERDETERMINED = {"learning_curve"}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - UNDERDETERMINED))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert compare(df, duck, ORACLES[name]) is None


def test_flagship_plan(spark, sf_dir):
    """Two exchanges, no join, only the needed columns, filters in the scan."""
    plan = plan_of(entry.queries()["weekly_features"](spark, sf_dir))
    assert plan.count("Exchange ") == 2 and "Join" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "props" not in scan and "IsNotNull(user_id)" in scan


@pytest.mark.parametrize("name", ["recommend_topk", "voluntary_decisions", "history_records"])
def test_row_local_plans_do_not_shuffle(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert "Exchange" not in plan


def test_small_stored_sides_are_broadcast(spark, sf_dir):
    plan = plan_of(entry.queries()["stratified_split"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", sorted((set(entry.queries()) - set(ORACLES)) | UNDERDETERMINED))
def test_query_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())

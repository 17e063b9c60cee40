"""Every registered query against its SQL counterpart on the driver's tables."""

import os

import pytest

import __spark_entry__ as entry_points
import compare
from lotlens.plans import registry

FOLDER = os.environ.get("LOTLENS_TEST_DATA", "/root/testdata/sf0.001")
NAMES = sorted(registry.QUERIES)
# Thresholds that the smallest tables do not reach.
MAY_BE_EMPTY = {"browse", "category_dominance", "audit_seed_lift", "top_terms", "gate_slim", "search_fuzzy"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(NAMES)
    assert set(NAMES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    problem = compare.diff(entry_points.queries()[name](spark, FOLDER), con, entry_points.oracle_sql()[name])
    if problem == "EMPTY on both sides" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0

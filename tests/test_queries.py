"""Every registered query beside its SQL on the smallest tables.

The two-cycle history is built once for all of them here; the registered queries themselves
build it from the tables each time.
"""

import os
from functools import cache

import pytest

import __spark_entry__ as entry
from seriesforge.plans import catalog, testbed
from tests.compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def shared_history():
    patch = pytest.MonkeyPatch()
    for name in ("history", "cycle_inputs", "rulebook"):
        patch.setattr(testbed, name, cache(getattr(testbed, name)))
    yield
    patch.undo()


def test_every_query_has_sql():
    assert set(catalog.queries()) <= entry.queries().keys() & entry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["REP_CTY", "DATE", "BATCH_STATUS", "FAILED_RULE_ID", "row_count"]


@pytest.mark.parametrize("query, rows", [("q_macro_rollup", 3161), ("q_validate", 6992)])
def test_known_sizes(spark, query, rows):
    if SF_DIR.endswith("sf0.001"):
        assert entry.queries()[query](spark, SF_DIR).count() == rows

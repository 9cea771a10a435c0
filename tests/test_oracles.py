"""Every registered query runs on the smallest tables and agrees with its SQL check."""

import pytest

import harness
from quillmap.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = harness.compare(spark, con, name, SF)
    assert ok, note
    assert "TYPES" not in note, note


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

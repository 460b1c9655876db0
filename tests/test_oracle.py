"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    found, rows = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert not found
    assert rows > 0 or name in ("equal_repeats",)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["host", "experiment_name", "measurement", "window_start", "mean"]
    assert df.count() > 0


def test_every_query_has_sql():
    from oracle_queries import ORACLES
    from phasebeat.plans.catalog import QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from wickline.catalog import oracles
from wickline.catalog.queries import registered
from oracle import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registered()) == set(oracles.statements())


def test_entry_registers_every_query():
    assert set(registered()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registered()))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, registered()[name], oracles.statements()[name], SF_DIR) is None


def test_entry_has_both_trends(spark):
    rows = entry.entry(spark).collect()
    assert [r.trend for r in sorted(rows, key=lambda r: r.trend_order)] == ["Uptrend", "Downtrend"]

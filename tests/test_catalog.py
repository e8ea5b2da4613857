"""Every registered query against DuckDB on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    _, n, verdict = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows only"), verdict
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["slot", "n", "n_correct", "n_errors", "error_rate"]

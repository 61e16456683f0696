"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import importlib

import pytest
from compare import connect, differences
from helpers import SMALL_FOLDER

from workload.oracles import oracle_sql
from workload.queries import queries

QUERIES = queries()
ORACLES = oracle_sql()
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL_FOLDER)


def test_registration_is_complete():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, folder, connection):
    result = QUERIES[name](spark, folder)
    assert differences(result, connection, ORACLES[name]) == []
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() > 0


def test_driver_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["config_id", "key", "value"]
    # The training data part adds its own, where it is there.
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())

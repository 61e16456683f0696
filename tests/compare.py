"""Compare a Spark result with the SQL result, ignoring row and column order."""

from __future__ import annotations

import datetime

import duckdb
from pyspark.sql import DataFrame

from workload.derived import TABLES


_SQL_TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    key = lambda row: tuple((value is None, str(value)) for value in row)
    return [columns[i] for i in order], sorted(table, key=key)


def differences(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, empty when names, types, row counts and values agree."""
    types = {row[0]: row[1] for row in connection.execute(f"describe {sql}").fetchall()}
    mine = {name: _SQL_TYPES.get(kind, kind) for name, kind in result.dtypes}
    if mine != types:
        return [f"types {mine} instead of {types}"]
    cursor = connection.execute(sql)
    expected = _canonical([d[0] for d in cursor.description], cursor.fetchall())
    actual = _canonical(result.columns, [tuple(r) for r in result.collect()])
    problems = []
    if len(actual[1]) != len(expected[1]):
        problems.append(f"{len(actual[1])} rows instead of {len(expected[1])}")
    for mine, theirs in zip(actual[1], expected[1]):
        if mine != theirs:
            problems.append(f"{mine} instead of {theirs}")
        if len(problems) > 3:
            break
    return problems

"""Helpers of the tests, under a module name of their own."""

from __future__ import annotations

SMALL_FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    """All rows as plain tuples, sorted with NULLs last."""
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return sorted((tuple(r) for r in df.collect()), key=key)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

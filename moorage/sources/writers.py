"""Writers of document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_json_documents(
    df: DataFrame, path: str, *, json: str = "json", mode: str = "errorifexists"
) -> None:
    """One JSON document per line. ``mode`` is Spark's save mode."""
    df.select(json).write.mode(mode).text(path)


def write_documents(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    *,
    text: str = "text",
    mode: str = "errorifexists",
) -> None:
    """Document texts as text files, in one folder per value of the key ``partition_by``."""
    if not partition_by:
        raise ValueError("documents need a key to be told apart by")
    df.select(*partition_by, text).write.mode(mode).partitionBy(*partition_by).text(path)

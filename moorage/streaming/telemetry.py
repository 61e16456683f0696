"""Telemetry of config records as they arrive.

Stateless: the batch operators run unchanged on each micro-batch, and the file sink
with its checkpoint makes the output exactly-once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..catalog import FIELDS, Field, config_schema
from ..operators.telemetry import reportable, telemetry_documents, telemetry_metrics


def config_stream(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | None = None,
    file_format: str = "json",
    files: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of the records in the files that arrive under ``path``."""
    reader = spark.readStream.format(file_format).schema(schema or config_schema())
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def telemetry_stream(
    configs: DataFrame,
    fields: Sequence[Field] = FIELDS,
    *,
    doc_id: str = "config_id",
    documents: bool = False,
    **options,
) -> DataFrame:
    """Metrics (or, with ``documents``, JSON documents) of the records that send telemetry."""
    sent = reportable(configs, doc_id=doc_id)
    operator = telemetry_documents if documents else telemetry_metrics
    return operator(sent, fields, doc_id=doc_id, **options)


def run_to_files(
    stream: DataFrame, path: str, checkpoint: str, *, file_format: str = "parquet"
) -> StreamingQuery:
    """Start writing everything now available to files; the same checkpoint resumes it."""
    return (
        stream.writeStream.format(file_format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

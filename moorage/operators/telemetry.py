"""Config records to redacted telemetry metrics and documents.

Both work on one record at a time: a scan, a projection and a filter, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import FIELDS, Field, applies_to, reported_fields
from ..functions.values import (
    has_user_info,
    rfc3339,
    seconds_text,
    unset_if_zero,
    without_user_info,
)

# Fixed values.
PRODUCT = "terraform-provider"
TELEMETRY_ID = "x" * 22
UPTIME_SECONDS = 0.6736922
DISTRIBUTION_METHOD = "DOCKER"


def _metric_values(
    config: DataFrame, fields: Sequence[Field], resource: str, redact_urls: bool
) -> dict[str, Column]:
    """Metric key to its text, NULL where the record does not report it."""
    values = {"product": F.lit(PRODUCT), "resource": F.col(resource)}
    for name, kinds in reported_fields(fields).items():
        if name not in config.columns:
            continue
        data_type = config.schema[name].dataType
        text = unset_if_zero(F.col(name), data_type).cast("string")
        if redact_urls and isinstance(data_type, T.StringType):
            text = F.when(has_user_info(text), without_user_info(text)).otherwise(text)
        values[name] = F.when(applies_to(kinds, F.col(resource)), text)
    return values


def telemetry_metrics(
    config: DataFrame,
    fields: Sequence[Field] = FIELDS,
    *,
    doc_id: str = "config_id",
    resource: str = "resource",
    redact_urls: bool = True,
) -> DataFrame:
    """(doc_id, key, value): product, resource and every reported, non-zero field."""
    values = _metric_values(config, fields, resource, redact_urls)
    wide = config.select(F.col(doc_id), *[v.alias(f"metric_{k}") for k, v in values.items()])
    return (
        wide.unpivot(doc_id, [f"metric_{k}" for k in values], "key", "value")
        .where(F.col("value").isNotNull())
        .withColumn("key", F.substr(F.col("key"), F.lit(len("metric_") + 1)))
    )


def telemetry_documents(
    config: DataFrame,
    fields: Sequence[Field] = FIELDS,
    *,
    doc_id: str = "config_id",
    resource: str = "resource",
    sent_at: str = "sent_at",
    version: str | Column = "",
    uptime_seconds: float | Column = UPTIME_SECONDS,
    redact_urls: bool = True,
    id_column: str | None = None,
) -> DataFrame:
    """(doc_id, json): the nested telemetry document of each record.

    The id in the document is ``doc_id``, or ``id_column`` where the rows are keyed otherwise.
    """
    values = _metric_values(config, fields, resource, redact_urls)
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    )
    version = version if isinstance(version, Column) else F.lit(version)
    uptime = uptime_seconds if isinstance(uptime_seconds, Column) else F.lit(uptime_seconds)
    document = F.struct(
        F.struct(
            F.coalesce(F.col(id_column or doc_id).cast("string"), F.lit("")).alias("id"),
            rfc3339(F.col(sent_at), config.schema[sent_at].dataType).alias("time"),
            F.lit(TELEMETRY_ID).alias("pmmServerTelemetryId"),
            version.alias("pmmServerVersion"),
            seconds_text(uptime).alias("upDuration"),
            F.lit(DISTRIBUTION_METHOD).alias("distributionMethod"),
            F.filter(entries, lambda m: m["value"].isNotNull()).alias("metrics"),
        ).alias("metrics")
    )
    return config.select(F.col(doc_id), F.to_json(document).alias("json"))


def reportable(
    config: DataFrame, *, doc_id: str = "config_id", opt_out: str = "disable_telemetry"
) -> DataFrame:
    """Records that send telemetry: an id was set and the owner did not opt out."""
    has_id = F.coalesce(F.col(doc_id).cast("string"), F.lit("")) != ""
    return config.where(has_id & ~F.coalesce(F.col(opt_out), F.lit(False)))

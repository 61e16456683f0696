"""Telemetry of a config table: defaults, opt-out, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.config import declared_defaults
from ..operators.telemetry import reportable, telemetry_documents


def report_telemetry(
    configs: DataFrame, *, sent_at: str = "sent_at", version: str = ""
) -> DataFrame:
    """(config_id, json) for every record that sends telemetry; one pass, no shuffle.

    Only declared defaults are reported, not those a cloud fills in later.
    """
    complete = declared_defaults(reportable(configs))
    return telemetry_documents(complete, sent_at=sent_at, version=version)

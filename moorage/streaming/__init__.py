"""Structured Streaming forms of the operators."""

from .delivery import Delivery, encoded_telemetry, files_receiver
from .telemetry import config_stream, run_to_files, telemetry_stream

__all__ = [
    "Delivery",
    "config_stream",
    "encoded_telemetry",
    "files_receiver",
    "run_to_files",
    "telemetry_stream",
]

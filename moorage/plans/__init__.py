"""Operators chained into the jobs of a fleet."""

from .cluster_files import cluster_files
from .registration import register_databases
from .store import read_document_store, upsert_documents, write_document_store
from .telemetry import report_telemetry

__all__ = [
    "cluster_files",
    "read_document_store",
    "register_databases",
    "report_telemetry",
    "upsert_documents",
    "write_document_store",
]

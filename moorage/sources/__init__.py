"""Readers and writers; every reader has an explicit schema."""

from .readers import (
    read_configs,
    read_ini_documents,
    read_json_documents,
    read_package_listings,
)
from .scratch import shared_folder
from .writers import write_documents, write_json_documents

__all__ = [
    "read_configs",
    "read_ini_documents",
    "read_json_documents",
    "read_package_listings",
    "shared_folder",
    "write_documents",
    "write_json_documents",
]

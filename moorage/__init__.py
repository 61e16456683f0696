"""Fleet inventory, configuration and telemetry analytics on Spark DataFrames."""

from .catalog import FIELDS, Field, catalog_frame, config_schema
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _operators

__all__ = ["FIELDS", "Field", "catalog_frame", "config_schema", *_operators]

"""The field catalog: every field of every resource kind, with its flags.

The catalog is part of the program, not data: operators turn it into column
expressions, so nothing has to be joined or broadcast at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    resources: tuple[str, ...]
    name: str
    type: str
    required: bool = False
    default: object = None
    sensitive: bool = False
    computed: bool = False


MACHINE = ("ps", "pxc", "pmm")
DATABASE = ("ps", "pxc")

_PAIR = "public_ip_address string, private_ip_address string"

# Field names, types, flags and defaults.
FIELDS: tuple[Field, ...] = (
    Field(MACHINE, "key_pair_name", "string", required=True),
    Field(MACHINE, "path_to_key_pair_storage", "string", default=".", sensitive=True),
    Field(MACHINE, "instance_type", "string", required=True),
    Field(MACHINE, "volume_type", "string"),
    Field(MACHINE, "volume_size", "int", default=20),
    Field(MACHINE, "volume_iops", "int"),
    Field(MACHINE, "vpc_name", "string"),
    Field(MACHINE, "volume_throughput", "int"),
    Field(MACHINE, "vpc_id", "string"),
    Field(DATABASE, "cluster_size", "int", default=3),
    Field(DATABASE, "config_file_path", "string"),
    Field(DATABASE, "version", "string"),
    Field(DATABASE, "port", "int", default=3306),
    Field(DATABASE, "password", "string", default="password", sensitive=True),
    Field(DATABASE, "pmm_address", "string"),
    Field(DATABASE, "pmm_password", "string", default="password", sensitive=True),
    Field(("ps",), "replication_type", "string", default="async"),
    Field(("ps",), "replication_password", "string", default="replicaPassword", sensitive=True),
    Field(("ps",), "myrocks_install", "boolean", default=False),
    Field(("ps",), "orchestrator_size", "int", default=0),
    Field(("ps",), "orchestrator_password", "string", default="password", sensitive=True),
    Field(("ps",), "instances", f"array<struct<{_PAIR}, is_replica boolean>>", computed=True),
    Field(("ps",), "orchestrator_instances", f"array<struct<{_PAIR}, url string>>", computed=True),
    Field(("pxc",), "galera_port", "int", default=4567),
    Field(("pxc",), "instances", f"array<struct<{_PAIR}>>", computed=True),
    Field(("pmm",), "rds_username", "string", default="", sensitive=True),
    Field(("pmm",), "rds_password", "string", default="", sensitive=True),
    Field(("pmm",), "rds_pmm_user_password", "string", default="password", sensitive=True),
    Field(("pmm",), "instances", f"array<struct<{_PAIR}>>", computed=True),
    Field(("pmm_rds",), "pmm_address", "string", required=True, sensitive=True),
    Field(("pmm_rds",), "rds_id", "string", required=True),
    Field(("pmm_rds",), "rds_username", "string", required=True),
    Field(("pmm_rds",), "rds_password", "string", required=True, sensitive=True),
    Field(("pmm_rds",), "rds_pmm_user_password", "string", default="password", sensitive=True),
)


def applies_to(field_resources: Sequence[str], resource: Column) -> Column:
    return resource.isin(*field_resources)


def reported_fields(fields: Sequence[Field]) -> dict[str, tuple[str, ...]]:
    """Field name to the resource kinds that report it: not sensitive, not computed."""
    reported: dict[str, tuple[str, ...]] = {}
    for field in fields:
        if not field.sensitive and not field.computed:
            reported[field.name] = reported.get(field.name, ()) + field.resources
    return reported


def config_schema(fields: Sequence[Field] = FIELDS) -> T.StructType:
    """Explicit reader schema of a config record: id, resource, cloud and the plain fields."""
    plain: dict[str, str] = {}
    for field in fields:
        if not field.computed:
            plain.setdefault(field.name, field.type)
    columns = ["config_id string", "resource string", "cloud string", "disable_telemetry boolean"]
    columns += [f"`{name}` {kind}" for name, kind in plain.items()]
    return T.StructType.fromDDL(", ".join(columns))


def catalog_frame(spark: SparkSession, fields: Sequence[Field] = FIELDS) -> DataFrame:
    """The catalog as a DataFrame, one row per resource kind and field."""
    rows = [
        (kind, f.name, f.type, f.required, None if f.default is None else str(f.default),
         f.sensitive, f.computed)
        for f in fields
        for kind in f.resources
    ]
    return spark.createDataFrame(
        rows,
        "resource string, field string, type string, required boolean, default string, "
        "sensitive boolean, computed boolean",
    ).withColumn("default", F.when(~F.col("sensitive"), F.col("default")))

"""Validation and defaults of config records; row-wise, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import FIELDS, Field, applies_to
from ..functions import semver
from ..functions.values import unset_if_zero

# Fixed values.
CLOUDS = ("aws", "gcp")
REPLICATION_TYPES = ("async", "group-replication")
SMALLEST_MANAGER_SIZE = 3
DEFAULT_VOLUME_TYPE = {"aws": "gp2", "gcp": "pd-balanced"}
DEFAULT_NETWORK = "default"
SUBNETWORK_SUFFIX = "-sub"


def _kinds_with(fields: Sequence[Field], name: str) -> tuple[str, ...]:
    return tuple(kind for f in fields if f.name == name for kind in f.resources)


def _rules(
    config: DataFrame, fields: Sequence[Field], resource: str, cloud: str, strict: bool
) -> dict[str, Column]:
    """Error code to the condition that raises it."""

    def owns(name: str) -> Column:
        return applies_to(_kinds_with(fields, name), F.col(resource))

    rules = {"cloud_unsupported": ~F.coalesce(F.col(cloud).isin(*CLOUDS), F.lit(False))}
    for field in fields:
        if field.required:
            missing = (
                unset_if_zero(F.col(field.name), config.schema[field.name].dataType).isNull()
                if field.name in config.columns
                else F.lit(True)
            )
            code = f"missing_{field.name}"
            fails = missing & applies_to(field.resources, F.col(resource))
            rules[code] = rules[code] | fails if code in rules else fails
    if "version" in config.columns:
        version = F.col("version")
        rules["version_empty"] = owns("version") & (version == "")
        rules["version_invalid"] = owns("version") & (version != "") & ~semver.is_valid(version)
    if "replication_type" in config.columns:
        kind = F.col("replication_type")
        rules["replication_type_unsupported"] = owns("replication_type") & ~kind.isin(
            *REPLICATION_TYPES
        )
    if "orchestrator_size" in config.columns:
        size = F.col("orchestrator_size")
        owned = owns("orchestrator_size")
        rules["orchestrator_size_too_small"] = (
            owned & (size < SMALLEST_MANAGER_SIZE) & (size > 0)
        )
        if strict:
            rules["orchestrator_size_negative"] = owned & (size < 0)
    return rules


def validate_config(
    config: DataFrame,
    fields: Sequence[Field] = FIELDS,
    *,
    resource: str = "resource",
    cloud: str = "cloud",
    strict: bool = False,
) -> DataFrame:
    """Add ``errors``, the codes of every rule a record breaks (empty when valid).

    A NULL version, replication type or size was not set and breaks no rule; an
    empty version was set. ``strict`` also rejects negative manager sizes.
    """
    rules = _rules(config, fields, resource, cloud, strict)
    raised = F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()])
    return config.withColumn("errors", F.array_compact(raised))


def error_counts(validated: DataFrame) -> DataFrame:
    """(error, records): how many records break each rule."""
    return (
        validated.select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def declared_defaults(
    config: DataFrame, fields: Sequence[Field] = FIELDS, *, resource: str = "resource"
) -> DataFrame:
    """Fill the defaults the catalog declares, for the resource kinds that declare them.

    Zero-valued fields count as unset.
    """
    columns: dict[str, Column] = {}
    for field in fields:
        if field.default is None or field.name not in config.columns:
            continue
        data_type = config.schema[field.name].dataType
        value = columns.get(field.name, F.col(field.name))
        filled = F.coalesce(unset_if_zero(value, data_type), F.lit(field.default).cast(data_type))
        columns[field.name] = F.when(
            applies_to(field.resources, F.col(resource)), filled
        ).otherwise(value)
    return config.withColumns(columns)


def cloud_defaults(config: DataFrame, *, cloud: str = "cloud") -> DataFrame:
    """Fill the volume type and networks of each cloud; zero volume speeds become unset.

    Adds ``subnetwork``, which only gcp has.
    """
    columns: dict[str, Column] = {}
    if "volume_type" in config.columns:
        per_cloud = F.lit(None).cast("string")
        for name, volume_type in DEFAULT_VOLUME_TYPE.items():
            per_cloud = F.when(F.col(cloud) == name, F.lit(volume_type)).otherwise(per_cloud)
        columns["volume_type"] = F.coalesce(F.nullif(F.col("volume_type"), F.lit("")), per_cloud)
    for name in ("volume_iops", "volume_throughput"):
        if name in config.columns:
            columns[name] = unset_if_zero(F.col(name), config.schema[name].dataType)
    if "vpc_name" in config.columns:
        on_gcp = F.col(cloud) == "gcp"
        network = F.coalesce(F.nullif(F.col("vpc_name"), F.lit("")), F.lit(DEFAULT_NETWORK))
        subnetwork = F.when(network == DEFAULT_NETWORK, network).otherwise(
            F.concat(network, F.lit(SUBNETWORK_SUFFIX))
        )
        columns["vpc_name"] = F.when(on_gcp, network).otherwise(F.col("vpc_name"))
        columns["subnetwork"] = F.when(on_gcp, subnetwork)
    return config.withColumns(columns)


def apply_defaults(
    config: DataFrame,
    fields: Sequence[Field] = FIELDS,
    *,
    resource: str = "resource",
    cloud: str = "cloud",
) -> DataFrame:
    """The declared defaults, then those of the cloud."""
    return cloud_defaults(declared_defaults(config, fields, resource=resource), cloud=cloud)

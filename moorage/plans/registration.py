"""Registration of discovered databases with the monitoring server."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inventory import (
    discovered_instances,
    lookup_instance,
    registration_json,
    registration_requests,
)

_COLUMNS = ("region", "az", "node_model", "address", "port", "engine")


def register_databases(
    discovery: DataFrame,
    requests: DataFrame,
    owner: str,
    *,
    order: str = "ord",
    json: str = "json",
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): request documents, and the wanted ids that cannot be registered.

    ``discovery`` has one response document per row with a listing position
    ``order``; ``requests`` has (request_id, wanted_id).
    """
    instances = discovered_instances(discovery, json=json, keep=[order])
    found = lookup_instance(requests, instances, order=order, columns=_COLUMNS)
    known = found.where(F.col("status") == "found").withColumnRenamed("wanted_id", "instance_id")
    accepted, unsupported = registration_requests(known, owner, keep=["request_id"])
    unknown = found.where(F.col("status") == "not_found").select(
        "request_id", F.col("wanted_id").alias("instance_id"), F.col("status").alias("reason")
    )
    rejected = unknown.unionByName(unsupported.select("request_id", "instance_id", "reason"))
    return registration_json(accepted, keep=["request_id", "instance_id"]), rejected

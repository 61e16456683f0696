"""Numbers of cluster members that stay as they are when further members arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import GROUP_ROWS, lookup, numbered
from .topology import with_roles


def high_marks(
    assigned: DataFrame, *, cluster: str = "cluster_id", marks: DataFrame | None = None
) -> DataFrame:
    """(cluster, high): the highest ``server_id`` that a cluster ever gave out.

    Stored from load to load and passed in again as ``marks``, it still counts members that
    have left since, so that no number is given twice. Combined map-side.
    """
    given = assigned.select(cluster, F.col("server_id").cast("bigint").alias("high"))
    if marks is not None:
        given = given.unionByName(marks.select(cluster, F.col("high").cast("bigint").alias("high")))
    return given.groupBy(cluster).agg(F.max("high").alias("high"))


def assign_new_roles(
    members: DataFrame,
    assigned: DataFrame,
    *,
    marks: DataFrame | None = None,
    cluster: str = "cluster_id",
    member: Sequence[str] = ("launch_ord",),
    order: str = "launch_ord",
    public_ip: str = "public_ip",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """``members`` with ``server_id``, ``is_replica``, ``bootstrap`` and ``manager_url``.

    ``assigned`` has (cluster, member..., server_id) of earlier loads, one row per member: who
    is in it keeps the number. The others go on from the cluster's highest one, by ``order``,
    wherever that would have put them among the earlier members, so loads in the order of
    positions number as one load does. The first member a cluster ever had is its bootstrap.

    Rows of the present load whose (cluster, member) repeats are numbered apart. A member with
    a NULL key is never one of before, and without a cluster numbers start at 1 in each load.
    Clusters of any size are numbered slice by slice, as in ``assign_roles``.
    """
    keys = [cluster, *member]
    kept = assigned.select(*keys, F.col("server_id").cast("bigint").alias("_kept"))
    marked = lookup(members, kept, keys, keys, limit)
    before = marked.where(F.col("_kept").isNotNull()).withColumn("server_id", F.col("_kept"))
    new = marked.where(F.col("_kept").isNull()).drop("_kept")
    highest = high_marks(assigned, cluster=cluster, marks=marks).withColumnRenamed("high", "_high")
    placed = numbered(new, [cluster], order, limit, highest).withColumn(
        "server_id", F.coalesce("_high", F.lit(0)) + F.col("pos")
    )
    every = before.drop("_kept").unionByName(placed.drop("_high", "pos", "n"))
    return with_roles(every, public_ip=public_ip).select(
        *members.columns, "server_id", "is_replica", "bootstrap", "manager_url"
    )

"""Config file of every cluster member: base settings, role settings, rendered text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.documents import quoted
from ..operators.groups import GROUP_ROWS, numbered
from ..operators.topology import INLINE, LIST_PART, SHARED, member_settings

# The section edited, and the settings that monitoring needs.
SERVER_SECTION = "mysqld"
MONITORING_SETTINGS = {
    "slow_query_log": "ON",
    "log_output": "FILE",
    "long_query_time": "0",
    "log_slow_admin_statements": "ON",
    "log_slow_slave_statements": "ON",
    "log_slow_rate_limit": "100",
    "log_slow_rate_type": "query",
    "slow_query_log_always_write_time": "1",
    "log_slow_verbosity": "full",
    "slow_query_log_use_global_control": "all",
    "performance_schema": "OFF",
    "userstat": "ON",
}


def _pairs(settings: Mapping[str, str]) -> Column:
    return F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in settings.items()]
    )


def overlaid(pairs: Column) -> Column:
    """The pairs of a row, later ones last: a key keeps its first place and its last value."""
    keys = F.array_distinct(F.transform(pairs, lambda pair: pair["key"]))
    return F.transform(
        keys,
        lambda key: F.struct(
            key.alias("key"),
            F.element_at(F.filter(pairs, lambda pair: pair["key"] == key), -1)["value"].alias(
                "value"
            ),
        ),
    )


def cluster_files(
    members: DataFrame,
    clusters: DataFrame,
    *,
    base: Mapping[str, str] | None = None,
    monitored: bool = True,
    cluster: str = "cluster_id",
    order: str = "launch_ord",
    private_ip: str = "private_ip",
    lists: str = INLINE,
    part_size: int = LIST_PART,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, address, part, text): one file per member, named cluster/listing position.

    The text lists the ``base`` settings, those for monitoring and the member's own, these
    by key; a later setting takes the place of an earlier one. Members without settings of
    their own get the others. Two members with one address have a file each.

    With ``lists="shared"`` (see ``instance_config``) the settings that list all members are a
    file of their own, named by the cluster alone, in parts: each has its stretch of the list
    under the same key, and the values joined by commas are the whole.
    """
    settings = member_settings(
        members, clusters, cluster=cluster, order=order, private_ip=private_ip, lists=lists,
        part_size=part_size, limit=limit,
    ).withColumn("settings", F.array_sort("settings"))
    own = settings.where(F.col("server_id").isNotNull())
    given = [_pairs(base)] if base else []
    given += [_pairs(MONITORING_SETTINGS)] if monitored else []
    nothing = F.array().cast("array<struct<key: string, value: string>>")
    placed = numbered(members.select(cluster, order, private_ip), [cluster], order, limit)
    every = placed.join(
        own.select(cluster, F.col("server_id").alias("pos"), "settings"), [cluster, "pos"], "left"
    ).select(
        F.concat_ws("/", F.col(cluster).cast("string"), F.col(order).cast("string")).alias("doc_id"),
        F.col(private_ip).alias("address"),
        F.lit(0).cast("bigint").alias("part"),
        overlaid(F.concat(*given, F.coalesce("settings", nothing))).alias("pairs"),
    )
    if lists == SHARED:
        every = every.unionByName(
            settings.where(F.col("server_id").isNull()).select(
                F.col(cluster).cast("string").alias("doc_id"),
                F.lit(None).cast("string").alias("address"),
                "part",
                F.col("settings").alias("pairs"),
            )
        )
    lines = F.transform(
        "pairs", lambda pair: F.concat(pair["key"], F.lit(" = "), quoted(pair["value"]))
    )
    body = F.array_join(lines, "\n")
    text = F.concat(F.lit(f"[{SERVER_SECTION}]\n"), body, F.lit("\n"))
    return every.where(F.size("pairs") > 0).select("doc_id", "address", "part", text.alias("text"))

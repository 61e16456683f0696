"""Desired against existing cloud resources, and tear-down lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import GROUP_ROWS, first_by, gathered, lookup, numbered

# Resource kinds in deletion order, and the suffix of each derived name.
DELETE_ORDER = (
    "instance",
    "route-table",
    "subnet",
    "security-group",
    "internet-gateway",
    "vpc",
)
AWS_SUFFIXES = {
    "internet-gateway": "-igw",
    "security-group": "-sg",
    "subnet": "-subnet",
    "route-table": "-rtb",
}
GCP_SUBNETWORK_SUFFIX = "-sub"
GCP_FIREWALL_SUFFIX = "-allow-all"
DEFAULT_NETWORK = "default"

# Ids per delete call.
BATCH_IDS = 1000


def parse_resource_names(df: DataFrame, column: str = "arn") -> DataFrame:
    """Add ``type``, ``id`` and ``reason`` (``not_an_arn`` or ``no_id``, NULL if accepted).

    The resource part is everything behind the fifth colon; its first two pieces
    between slashes are type and id.
    """
    arn = F.col(column)
    # NULL unless there are six parts.
    resource = F.when(F.startswith(arn, F.lit("arn:")), F.get(F.split(arn, ":", 6), F.lit(5)))
    pieces = F.col("_pieces")
    identity = F.get(pieces, F.lit(1))
    return (
        df.withColumn("_pieces", F.split(resource, "/"))
        .withColumns(
            {
                "type": F.when(F.size(pieces) > 1, F.get(pieces, F.lit(0))),
                "id": identity,
                "reason": F.when(pieces.isNull(), "not_an_arn").when(
                    F.size(pieces) < 2, "no_id"
                ),
            }
        )
        .drop("_pieces")
    )


def group_resource_ids(
    parsed: DataFrame,
    *,
    order: str = "ord",
    batch: int = BATCH_IDS,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(type, delete_rank, batch, ids, n): the ids of each type in arrival order.

    A type's ids come in consecutive batches of up to ``batch``, the size of one
    delete call, so a type of any size never meets in one task. ``delete_rank``
    orders the deletion; a type outside it has NULL.
    """
    known = parsed.where(F.col("id").isNotNull()).select("type", "id", order)
    rank = F.array_position(F.array(*[F.lit(kind) for kind in DELETE_ORDER]), F.col("type"))
    batches = numbered(known, ["type"], order, limit).withColumn(
        "batch", F.expr(f"(pos - 1) div {batch}")
    )
    return gathered(batches, ["type", "batch"], "pos", "id").select(
        "type",
        F.nullif(rank, F.lit(0)).cast("int").alias("delete_rank"),
        "batch",
        F.col("id").alias("ids"),
        F.size("id").alias("n"),
    )


def reconcile_resources(
    desired: DataFrame,
    actual: DataFrame,
    *,
    desired_id: str = "desired_id",
    want_id: str = "want_id",
    want_name: str = "want_name",
    act_id: str = "act_id",
    act_name: str = "act_name",
    order: str = "ord",
    compare: str | None = None,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``match_ord``, ``match_id``, ``match_name``, ``matched_by`` and ``action``.

    An explicit id is tried first, then the name; an empty id or name is not tried.
    The first listed resource wins. Without a match the action is ``create``, with
    one it is ``reuse``; with a ``compare`` column present on both sides it is
    ``missing_local`` where the desired content is NULL and ``conflict`` where it
    differs.
    """
    kept = [order, act_id, act_name] + ([compare] if compare else [])

    def first_listed(key: str, prefix: str) -> DataFrame:
        existing = actual.where(F.coalesce(F.col(key), F.lit("")) != "").select(
            F.col(key).alias(f"_{prefix}_key"), *kept
        )
        first = first_by(existing, [f"_{prefix}_key"], order, *kept)
        return first.select(
            f"_{prefix}_key", F.struct(*[F.col(c) for c in kept]).alias(f"_{prefix}")
        )

    with_id = desired.withColumn("_id_key", F.nullif(F.col(want_id), F.lit("")))
    by_id = lookup(with_id, first_listed(act_id, "id"), ["_id_key"], [desired_id], limit)
    name = F.nullif(F.col(want_name), F.lit(""))
    with_name = by_id.withColumn("_name_key", F.when(F.col("_id").isNull(), name))
    # No name can be tried more often than it is wanted.
    wanted_names = desired.select(name.alias("_name_key"))
    both = lookup(
        with_name, first_listed(act_name, "name"), ["_name_key"], [desired_id], limit, wanted_names
    )
    match = F.coalesce(F.col("_id"), F.col("_name"))
    action = F.when(match.isNull(), "create")
    if compare:
        action = action.when(F.col(compare).isNull(), "missing_local").when(
            ~F.col(compare).eqNullSafe(match[compare]), "conflict"
        )
    return both.withColumns(
        {
            "match_ord": match[order],
            "match_id": match[act_id],
            "match_name": match[act_name],
            "matched_by": F.when(F.col("_id").isNotNull(), "id").when(
                F.col("_name").isNotNull(), "name"
            ),
            "action": action.otherwise("reuse"),
        }
    ).drop("_id_key", "_name_key", "_id", "_name")


def orphaned_resources(
    actual: DataFrame, reconciled: DataFrame, *, order: str = "ord"
) -> DataFrame:
    """Existing resources that no desired one was matched to."""
    taken = reconciled.where(F.col("match_ord").isNotNull()).select(
        F.col("match_ord").alias(order)
    )
    return actual.join(taken.distinct(), order, "left_anti")


def expected_resources(
    networks: DataFrame,
    *,
    network_id: str = "vpc_id",
    network_name: str = "vpc_name",
    cloud: str = "cloud",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(keep..., network, kind, name): the resources that belong to each network.

    On aws the names derive from the network's name and are NULL without one, but
    the security group falls back to the id. On gcp the default network keeps its
    own subnetwork.
    """
    name = F.nullif(F.col(network_name), F.lit(""))
    aws = [
        F.struct(
            F.col(network_id).alias("network"),
            F.lit(kind).alias("kind"),
            F.concat(
                F.coalesce(name, F.col(network_id)) if kind == "security-group" else name,
                F.lit(suffix),
            ).alias("name"),
        )
        for kind, suffix in AWS_SUFFIXES.items()
    ]
    network = F.coalesce(name, F.lit(DEFAULT_NETWORK))
    subnetwork = F.when(network == DEFAULT_NETWORK, network).otherwise(
        F.concat(network, F.lit(GCP_SUBNETWORK_SUFFIX))
    )
    gcp = [
        F.struct(network.alias("network"), F.lit(kind).alias("kind"), value.alias("name"))
        for kind, value in (
            ("network", network),
            ("subnetwork", subnetwork),
            ("firewall", F.concat(network, F.lit(GCP_FIREWALL_SUFFIX))),
        )
    ]
    rows = F.when(F.col(cloud) == "aws", F.array(*aws)).when(F.col(cloud) == "gcp", F.array(*gcp))
    return networks.select(*keep, F.inline(rows))

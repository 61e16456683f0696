"""The resources that a request needs, got or created along their dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .groups import GROUP_ROWS, first_by, lookup
from .reconcile import expected_resources, reconcile_resources

# The kind that everything depends on, the one found by name alone, and the
# one that counts only with a route to everywhere.
NETWORK = "vpc"
SECURITY_GROUP = "security-group"
ROUTE_TABLE = "route-table"


def reconcile_chain(
    requests: DataFrame,
    networks: DataFrame,
    resources: DataFrame,
    *,
    request_id: str = "request_id",
    request_order: str = "request_ord",
    want_id: str = "want_id",
    want_name: str = "want_name",
    order: str = "ord",
    act_id: str = "act_id",
    act_name: str = "act_name",
    kind: str = "kind",
    network_id: str = "network_id",
    default_route: str = "default_route",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(request_id, kind, name, action, act_id, created_by): five rows per request.

    Requests are served one after the other, by ``request_order``; what one creates the next
    ones find. ``networks`` (order, act_id, act_name) and ``resources`` (order, kind, act_id,
    act_name, network_id, default_route) exist before; the first listed match wins.

    1. A network is found by its id, else by its name, else created; one that an earlier
       request created under that name is found as well. Without a name it is always created.
    2. The name of the network, as found or as asked for, gives the names of what belongs to
       it. Gateway, subnet and route table are looked for in the network, by name if it has
       one; a route table needs a default route. A new network has none, so they are created.
    3. A security group is looked for by name alone, in whatever network; where the network has
       no name it goes by the network's id. That of a new network without a name is created.

    ``action`` is ``reuse`` (``act_id`` tells what), ``create``, or ``reuse_created`` for what an
    earlier request, ``created_by``, creates. Ids and positions of requests are unique; an id or
    name that is NULL or empty is not asked for.

    What belongs to a network is worked out once per network in use and then looked up by the
    requests, also where one network serves a great part of them. The requests with their
    networks are written once to the scratch folder.
    """
    asked = requests.select(
        F.col(request_id).alias("_request"),
        F.col(request_order).alias("_order"),
        F.col(want_id).alias("_want_id"),
        F.col(want_name).alias("_want_name"),
    )
    matched = reconcile_resources(
        asked, networks, desired_id="_request", want_id="_want_id", want_name="_want_name",
        act_id=act_id, act_name=act_name, order=order, limit=limit,
    )
    new = F.col("match_id").isNull()
    name = F.nullif(F.when(new, F.col("_want_name")).otherwise(F.col("match_name")), F.lit(""))
    placed = matched.select(
        "_request", "_order", F.col("match_id").alias("_existing"), name.alias("_network_name"),
        F.when(new, name).alias("_new_name"),
    )
    creators = first_by(placed.where("_new_name is not null"), ["_new_name"], "_order", "_request")
    creators = creators.withColumnRenamed("_request", "_first_asked")
    # No name can be new more often than it is wanted.
    wanted_names = asked.select(F.nullif("_want_name", F.lit("")).alias("_new_name"))
    placed = lookup(placed, creators, ["_new_name"], ["_request"], limit, wanted_names)
    creator = F.when(F.col("_existing").isNull(), F.coalesce("_first_asked", "_request"))
    placed = written(placed.withColumn("_network", F.struct("_existing", creator.alias("_creator"))), "placed")

    used = first_by(placed, ["_network"], "_order", "_request", "_order", "_network_name")
    belongs = expected_resources(
        used.withColumns({"_existing": F.col("_network._existing"), "_cloud": F.lit("aws")}),
        network_id="_existing", network_name="_network_name", cloud="_cloud",
        keep=("_network", "_request", "_order"),
    )
    is_group = F.col("kind") == SECURITY_GROUP
    wanted = belongs.select(
        "_network", "kind", "name", F.col("_request").alias("_first"), F.col("_order").alias("_first_order"),
        F.when(is_group, F.lit("")).otherwise(F.col("_network._existing").cast("string")).alias("_scope"),
        F.when(is_group, F.col("name")).otherwise(F.coalesce("name", F.lit(""))).alias("_name"),
    )

    there = resources.select(
        F.col(kind).alias("kind"), F.col(order).alias("_listed"), F.col(act_id).alias("_found"),
        F.coalesce(act_name, F.lit("")).alias("_name"), F.col(network_id).cast("string").alias("_scope"),
        F.coalesce(default_route, F.lit(False)).alias("_routed"),
    )
    within = there.where(~is_group & ((F.col("kind") != ROUTE_TABLE) | F.col("_routed"))).drop("_routed")
    by_name = there.where(is_group).drop("_routed").withColumn("_scope", F.lit(""))
    # Where no name is asked for, whatever the network has will do.
    index = (
        within.withColumn("_name", F.lit(""))
        .unionByName(within.where("_name <> ''"))
        .unionByName(by_name.where("_name <> ''"))
    )
    keys = ["kind", "_scope", "_name"]
    found = wanted.join(first_by(index, keys, "_listed", "_found"), keys, "left")

    # Several networks of one name share a group: who comes first creates it.
    missing = F.when(is_group & F.col("_found").isNull(), F.col("name"))
    found = found.withColumn("_missing", missing)
    group_creators = first_by(found.where("_missing is not null"), ["_missing"], "_first_order", "_first")
    group_creators = group_creators.withColumnRenamed("_first", "_first_group")
    found = found.join(group_creators, ["_missing"], "left")
    by = F.when(F.col("_found").isNull(), F.coalesce("_first_group", "_first"))
    entry = F.struct("kind", "name", F.col("_found").alias("act_id"), by.alias("created_by"))
    lists = found.groupBy("_network").agg(F.collect_list(entry).alias("_entries"))

    network = F.struct(
        F.lit(NETWORK).alias("kind"), F.col("_network_name").alias("name"),
        F.col("_network._existing").alias("act_id"), F.col("_network._creator").alias("created_by"),
    )
    rows = lookup(placed, lists, ["_network"], ["_request"], limit).select(
        "_request", F.inline(F.concat(F.array(network), "_entries"))
    )
    action = (
        F.when(F.col("act_id").isNotNull(), "reuse")
        .when(F.col("created_by") == F.col("_request"), "create")
        .otherwise("reuse_created")
    )
    return rows.select(
        F.col("_request").alias(request_id), "kind", "name", action.alias("action"), "act_id", "created_by"
    )

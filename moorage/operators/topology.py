"""Members of clusters: roles, peer lists, readiness and per-member settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import compact_json_column
from .groups import GROUP_ROWS, numbered

# Ports, addresses and the settings of each kind of cluster.
GROUP_PORT = 33061
SERVER_PORT = 3306
GALERA_PORT = 4567
MANAGER_PORT = 3000
MANAGER_PREFIX = "orchestrator"
MANAGER_RAFT_PORT = 10008
MANAGER_CREDENTIALS_PATH = "/etc/mysql/orchestrator-topology.cnf"
ASYNC = "async"
GROUP = "group-replication"
XTRADB = "xtradb"
KINDS = (ASYNC, GROUP, XTRADB)
SOURCE_SETTINGS = {
    "log_bin": "/var/log/mysql/mysql-bin.log",
    "relay-log": "/var/log/mysql/mysql-relay-bin.log",
    "gtid-mode": "ON",
    "enforce-gtid-consistency": "ON",
}
GROUP_SETTINGS = {
    "disabled_storage_engines": "MyISAM,BLACKHOLE,FEDERATED,ARCHIVE,MEMORY",
    "plugin_load_add": "group_replication.so",
    "group_replication_start_on_boot": "off",
    "group_replication_bootstrap_group": "off",
}
XTRADB_SETTINGS = {"pxc-encrypt-cluster-traffic": "OFF"}

# Members that one part of a cluster's lists holds.
LIST_PART = 1000
# Lists of all members: once per cluster in parts, or whole for every member.
SHARED, INLINE = "shared", "inline"


def _manager_url(address: Column) -> Column:
    return F.concat(F.lit("http://"), address, F.lit(f":{MANAGER_PORT}/{MANAGER_PREFIX}"))


def with_roles(numbered_members: DataFrame, *, public_ip: str = "public_ip") -> DataFrame:
    """Add ``is_replica``, ``bootstrap`` and ``manager_url`` to members that have a ``server_id``."""
    return numbered_members.withColumns(
        {
            "is_replica": F.col("server_id") > 1,
            "bootstrap": F.col("server_id") == 1,
            "manager_url": _manager_url(F.col(public_ip)),
        }
    )


def assign_roles(
    members: DataFrame,
    *,
    cluster: str = "cluster_id",
    order: str = "launch_ord",
    public_ip: str = "public_ip",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``server_id`` (1-based), ``is_replica``, ``bootstrap`` and ``manager_url``."""
    placed = numbered(members, [cluster], order, limit).withColumn("server_id", F.col("pos"))
    return with_roles(placed, public_ip=public_ip).drop("pos", "n")


def _in_parts(
    members: DataFrame,
    cluster: str,
    order: str,
    private_ip: str,
    part_size: int,
    limit: int,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """(cluster, part, n, nodes): members by position, ``part_size`` to a part, parts 0, 1, 2, ...

    ``nodes`` are (pos, address) in listing order, ``n`` the size of the cluster; the columns
    of ``per_group`` come along.
    """
    placed = numbered(members.select(cluster, order, private_ip), [cluster], order, limit, per_group)
    further = [c for c in per_group.columns if c != cluster] if per_group is not None else []
    node = F.struct("pos", F.col(private_ip).alias("address"))
    return (
        placed.withColumn("part", F.expr(f"(pos - 1) div {part_size}"))
        .groupBy(cluster, "part")
        .agg(
            F.any_value("n").alias("n"),
            F.sort_array(F.collect_list(node)).alias("nodes"),
            *[F.any_value(c).alias(c) for c in further],
        )
    )


def peer_lists(
    members: DataFrame,
    *,
    cluster: str = "cluster_id",
    order: str = "launch_ord",
    private_ip: str = "private_ip",
    galera_port: int = GALERA_PORT,
    part_size: int = LIST_PART,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(cluster, part, n, nodes, allow_list, seeds, cluster_address, manager_urls).

    Every form of a cluster's address list, in listing order, in parts 0, 1, 2, ... of
    ``part_size`` members; the parts' texts joined by the list's separator are the whole list.
    """
    rows = _in_parts(members, cluster, order, private_ip, part_size, limit)
    nodes, part = F.transform("nodes", lambda node: node["address"]), F.col("part")
    return rows.select(
        cluster,
        part,
        F.size("nodes").alias("n"),
        nodes.alias("nodes"),
        _allow_list(nodes).alias("allow_list"),
        _seeds(nodes).alias("seeds"),
        _cluster_address(nodes, galera_port, part).alias("cluster_address"),
        F.array_join(F.transform(nodes, _manager_url), " ").alias("manager_urls"),
    )


def _with_port(nodes: Column, port: int) -> Column:
    return F.array_join(F.transform(nodes, lambda a: F.concat(a, F.lit(f":{port}"))), ",")


def _allow_list(nodes: Column) -> Column:
    return F.array_join(nodes, ",")


def _seeds(nodes: Column) -> Column:
    return _with_port(nodes, GROUP_PORT)


def _cluster_address(nodes: Column, port: int, part: Column) -> Column:
    scheme = F.when(part == 0, "gcomm://").otherwise("")
    return F.concat(scheme, _with_port(nodes, port))


def cluster_readiness(
    members: DataFrame,
    clusters: DataFrame,
    *,
    cluster: str = "cluster_id",
    public_ip: str = "public_ip",
    reachable: str = "reachable",
) -> DataFrame:
    """(cluster, members, ready): every member has an address and answered; none is not ready."""
    answers = (F.coalesce(F.col(public_ip), F.lit("")) != "") & F.coalesce(
        F.col(reachable), F.lit(False)
    )
    counted = members.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("members"), F.every(answers).alias("ready")
    )
    return (
        clusters.select(cluster)
        .join(counted, cluster, "left")
        .select(
            cluster,
            F.coalesce("members", F.lit(0).cast("bigint")).alias("members"),
            F.coalesce("ready", F.lit(False)).alias("ready"),
        )
    )


def _settings(pairs: dict[str, str | Column]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                (value if isinstance(value, Column) else F.lit(value)).alias("value"),
            )
            for key, value in pairs.items()
        ]
    )


def _own_settings(
    kind: Column, size: Column, name: Column, pos: Column, address: Column,
    server_port: int, galera_port: int,
) -> Column:
    """What a member has for itself, as (key, value) pairs; NULL without any."""
    every = {"server_id": pos.cast("string"), **SOURCE_SETTINGS}
    own_async = {
        **every,
        "bind-address": F.when(pos == 1, F.concat(address, F.lit(",localhost"))),
    }
    own_group = {
        **every,
        **GROUP_SETTINGS,
        "group_replication_group_name": name,
        "group_replication_local_address": F.concat(address, F.lit(f":{GROUP_PORT}")),
    }
    own_xtradb = {
        "port": str(server_port),
        "wsrep_node_name": address,
        "wsrep_node_address": F.concat(address, F.lit(f":{galera_port}")),
        "wsrep_provider_options": f"base_port={galera_port}",
        **XTRADB_SETTINGS,
    }
    pairs = (
        F.when((kind == ASYNC) & (size > 1), _settings(own_async))
        .when(kind == GROUP, _settings(own_group))
        .when(kind == XTRADB, _settings(own_xtradb))
    )
    return F.filter(pairs, lambda pair: pair["value"].isNotNull())


def _list_settings(kind: Column, nodes: Column, part: Column, galera_port: int) -> Column:
    """The settings that list members, as (key, value) pairs; NULL without any."""
    group = {
        "group_replication_group_seeds": _seeds(nodes),
        "group_replication_ip_allowlist": _allow_list(nodes),
    }
    xtradb = {"wsrep_cluster_address": _cluster_address(nodes, galera_port, part)}
    return F.when(kind == GROUP, _settings(group)).when(kind == XTRADB, _settings(xtradb))


def member_settings(
    members: DataFrame,
    clusters: DataFrame,
    *,
    cluster: str = "cluster_id",
    order: str = "launch_ord",
    private_ip: str = "private_ip",
    kind: str = "kind",
    group_name: str | None = None,
    server_port: int = SERVER_PORT,
    galera_port: int = GALERA_PORT,
    lists: str = SHARED,
    part_size: int = LIST_PART,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(cluster, instance, server_id, part, settings): settings as an array of (key, value).

    See :func:`instance_config`, which has a row for each setting.
    """
    if lists not in (SHARED, INLINE):
        raise ValueError(f"lists must be {SHARED} or {INLINE}")
    given_name = [F.col(group_name).cast("string").alias("_group_name")] if group_name else []
    described = clusters.select(cluster, F.col(kind).alias("_kind"), *given_name)
    described = described.where(F.col("_kind").isin(*KINDS))
    name = F.col("_group_name") if group_name else _derived_uuid(F.col(cluster))
    parts = _in_parts(members, cluster, order, private_ip, part_size, limit, described)
    parts = parts.where(F.col("_kind").isNotNull())
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")

    def own(node: Column) -> Column:
        return F.struct(
            node["address"].alias("instance"),
            node["pos"].alias("server_id"),
            zero.alias("part"),
            _own_settings(
                F.col("_kind"), F.col("n"), name, node["pos"], node["address"],
                server_port, galera_port,
            ).alias("settings"),
        )

    addresses = F.transform("nodes", lambda node: node["address"])
    if lists == SHARED:
        shared = F.struct(
            none.alias("instance"),
            F.lit(None).cast("bigint").alias("server_id"),
            F.col("part").alias("part"),
            _list_settings(F.col("_kind"), addresses, F.col("part"), galera_port).alias("settings"),
        )
        found = parts.select(
            cluster, F.inline(F.concat(F.transform("nodes", own), F.array(shared)))
        )
        return found.where(F.col("settings").isNotNull())
    whole = _whole_lists(parts, cluster)
    listing = _list_settings(F.col("_kind"), F.col("_all"), zero, galera_port)
    return (
        parts.select(cluster, "_kind", F.inline(F.transform("nodes", own)))
        .join(whole, cluster)
        .withColumn(
            "settings",
            F.when(F.col("_kind") == ASYNC, F.col("settings")).otherwise(
                F.concat("settings", listing)
            ),
        )
        .where(F.col("settings").isNotNull())
        .drop("_kind", "_all")
    )


def _whole_lists(parts: DataFrame, cluster: str) -> DataFrame:
    """(cluster, _all): all addresses of a cluster in order. As large as the cluster."""
    in_order = F.sort_array(F.collect_list(F.struct("part", "nodes")))
    nodes = F.flatten(F.transform(in_order, lambda part: part["nodes"]))
    return parts.groupBy(cluster).agg(F.transform(nodes, lambda node: node["address"]).alias("_all"))


def instance_config(
    members: DataFrame,
    clusters: DataFrame,
    *,
    cluster: str = "cluster_id",
    order: str = "launch_ord",
    private_ip: str = "private_ip",
    kind: str = "kind",
    group_name: str | None = None,
    server_port: int = SERVER_PORT,
    galera_port: int = GALERA_PORT,
    lists: str = SHARED,
    part_size: int = LIST_PART,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(cluster, instance, server_id, part, key, value): the settings of every member.

    Async clusters get theirs only with more than one member; other kinds always;
    unknown kinds and members of unlisted clusters get none (see ``config_status``).
    The group name is ``group_name`` or, if not given, derived from the cluster id.

    The caller chooses how settings that list all members are written, and a cluster's
    size never changes it. ``lists="shared"``: once per cluster, with ``instance`` NULL, in parts of
    ``part_size`` members as in :func:`peer_lists`. ``lists="inline"``: for every member, as each
    member's server needs them; that gathers a cluster in one row and grows with its square.
    """
    found = member_settings(
        members, clusters, cluster=cluster, order=order, private_ip=private_ip, kind=kind,
        group_name=group_name, server_port=server_port, galera_port=galera_port,
        lists=lists, part_size=part_size, limit=limit,
    )
    return found.select(cluster, "instance", "server_id", "part", F.inline("settings"))


def _derived_uuid(cluster: Column) -> Column:
    """A stable group name in UUID form from the cluster id."""
    digest = F.md5(cluster.cast("string").cast("binary"))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def config_status(
    members: DataFrame,
    clusters: DataFrame,
    *,
    cluster: str = "cluster_id",
    kind: str = "kind",
) -> DataFrame:
    """(cluster, kind, members, status): which clusters get settings, and why others do not."""
    counted = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
    size = F.coalesce("members", F.lit(0).cast("bigint"))
    status = (
        F.when(~F.coalesce(F.col(kind).isin(*KINDS), F.lit(False)), "unknown_kind")
        .when(size == 0, "no_members")
        .when((F.col(kind) == ASYNC) & (size == 1), "single_member")
        .otherwise("configured")
    )
    return (
        clusters.select(cluster, kind)
        .join(counted, cluster, "left")
        .select(cluster, kind, size.alias("members"), status.alias("status"))
    )


def manager_config(
    members: DataFrame,
    *,
    cluster: str = "cluster_id",
    order: str = "launch_ord",
    private_ip: str = "private_ip",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(cluster, instance, json): the topology manager's config per instance.

    Every document lists all of its cluster's managers as ``RaftNodes``, so the result
    grows with the square of a cluster, at any size.
    """
    parts = _in_parts(members, cluster, order, private_ip, LIST_PART, limit)
    placed = parts.select(
        cluster, F.explode(F.transform("nodes", lambda node: node["address"])).alias("instance")
    ).join(_whole_lists(parts, cluster), cluster)
    values: dict[str, object] = {
        "Debug": True,
        "ListenAddress": f":{MANAGER_PORT}",
        "MySQLTopologyCredentialsConfigFile": MANAGER_CREDENTIALS_PATH,
        "BackendDB": "sqlite",
        "SQLite3DataFile": "/var/lib/orchestrator/orchestrator.db",
        "RaftEnabled": True,
        "RaftBind": F.col("instance"),
        "RaftDataDir": "/var/lib/orchestrator",
        "DefaultRaftPort": MANAGER_RAFT_PORT,
        "RaftNodes": F.col("_all"),
        "DiscoverByShowSlaveHosts": False,
        "InstancePollSeconds": 5,
        "InstanceFlushIntervalMilliseconds": 100,
        "HostnameResolveMethod": "none",
        "MySQLHostnameResolveMethod": "@@hostname",
        "URLPrefix": f"/{MANAGER_PREFIX}",
    }
    columns = [
        (value if isinstance(value, Column) else F.lit(value)).alias(key)
        for key, value in values.items()
    ]
    wide = placed.select(cluster, "instance", *columns)
    return wide.select(cluster, "instance", compact_json_column(wide, list(values)).alias("json"))

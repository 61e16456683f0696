from __future__ import annotations

import json

import pytest
from helpers import rows_of

import moorage as m


# Cluster to its member addresses in launch order; d has none, u is of an unknown kind.
FLEET = {
    "a": ["10.0.0.1", "10.0.0.2", "10.0.0.3"],
    "g": ["10.1.0.1", "10.1.0.2", "10.1.0.3", "10.1.0.4", "10.1.0.5"],
    "x": ["10.2.0.1", "10.2.0.2", "10.2.0.3", "10.2.0.4"],
    "s": ["10.3.0.1"],
    "o": ["10.4.0.1"],
    "u": ["10.5.0.1", "10.5.0.2"],
}
KINDS = {"a": "async", "g": "group-replication", "x": "xtradb", "s": "async",
         "o": "group-replication", "u": "ring", "d": "async"}


@pytest.fixture(scope="module")
def members(spark):
    rows = [
        (cluster, 10 * i + 3, ip, ip.replace("10.", "34.", 1), True)
        for cluster, ips in FLEET.items()
        for i, ip in enumerate(ips)
    ]
    rows.append(("lost", 1, "10.9.0.1", "", True))
    return spark.createDataFrame(
        rows[::-1],
        "cluster_id string, launch_ord int, private_ip string, public_ip string, reachable boolean",
    ).repartition(3)


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame(list(KINDS.items()), "cluster_id string, kind string")


@pytest.mark.parametrize("limit", [1, 2, 1_000_000])
def test_roles(members, limit):
    roles = m.assign_roles(members, limit=limit)
    got = {(r.cluster_id, r.private_ip): r for r in roles.collect()}
    for cluster, ips in FLEET.items():
        for i, ip in enumerate(ips):
            row = got[cluster, ip]
            assert (row.server_id, row.is_replica, row.bootstrap) == (i + 1, i != 0, i == 0)
            assert row.manager_url == f"http://{row.public_ip}:3000/orchestrator"


def test_peer_lists(members):
    rows = {r.cluster_id: r for r in m.peer_lists(members).collect()}
    g = rows["g"]
    assert (g.part, g.n, g.nodes) == (0, 5, FLEET["g"])
    assert g.allow_list == ",".join(FLEET["g"])
    assert g.seeds == ",".join(f"{ip}:33061" for ip in FLEET["g"])
    assert g.cluster_address == "gcomm://" + ",".join(f"{ip}:4567" for ip in FLEET["g"])
    assert g.manager_urls == " ".join(f"http://{ip}:3000/orchestrator" for ip in FLEET["g"])


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_parts_of_a_large_peer_list_make_the_whole(members, limit):
    found = m.peer_lists(members, part_size=2, limit=limit).collect()
    whole = {}
    for r in sorted(found, key=lambda r: (r.cluster_id, r.part)):
        assert r.n <= 2
        whole.setdefault((r.cluster_id, "part"), []).append(r.part)
        for column in ("allow_list", "seeds", "cluster_address"):
            whole.setdefault((r.cluster_id, column), []).append(r[column])
    assert whole["g", "part"] == [0, 1, 2] and whole["s", "part"] == [0]
    for cluster, ips in FLEET.items():
        assert ",".join(whole[cluster, "allow_list"]) == ",".join(ips)
        assert ",".join(whole[cluster, "cluster_address"]) == "gcomm://" + ",".join(
            f"{ip}:4567" for ip in ips
        )


def test_readiness(spark, clusters):
    rows = [("a", "1", True), ("a", "2", True), ("g", "", True), ("g", "2", True),
            ("x", "1", False), ("s", None, True), ("o", "1", None)]
    df = spark.createDataFrame(rows, "cluster_id string, public_ip string, reachable boolean")
    got = {r.cluster_id: (r.members, r.ready) for r in m.cluster_readiness(df, clusters).collect()}
    assert got == {"a": (2, True), "g": (2, False), "x": (1, False), "s": (1, False),
                   "o": (1, False), "u": (0, False), "d": (0, False)}


def settings_of(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.cluster_id, r.instance), {})[r.key] = r.value
    return found


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_settings_per_member(members, clusters, limit):
    got = settings_of(m.instance_config(members, clusters, lists="inline", limit=limit))
    # One async member, unknown kinds and unlisted clusters get nothing.
    assert {cluster for cluster, _ in got} == {"a", "g", "x", "o"}
    first, second = got["a", "10.0.0.1"], got["a", "10.0.0.2"]
    assert first == {
        "server_id": "1", "log_bin": "/var/log/mysql/mysql-bin.log",
        "relay-log": "/var/log/mysql/mysql-relay-bin.log", "gtid-mode": "ON",
        "enforce-gtid-consistency": "ON", "bind-address": "10.0.0.1,localhost",
    }
    assert second["server_id"] == "2" and "bind-address" not in second
    group = got["g", "10.1.0.3"]
    assert len(group) == 13
    assert group["group_replication_local_address"] == "10.1.0.3:33061"
    assert group["group_replication_ip_allowlist"] == ",".join(FLEET["g"])
    assert len({got["g", ip]["group_replication_group_name"] for ip in FLEET["g"]}) == 1
    assert group["group_replication_group_name"] != got["o", "10.4.0.1"]["group_replication_group_name"]
    assert len(got["o", "10.4.0.1"]) == 13
    assert got["x", "10.2.0.2"] == {
        "port": "3306", "wsrep_node_name": "10.2.0.2", "wsrep_node_address": "10.2.0.2:4567",
        "wsrep_provider_options": "base_port=4567", "pxc-encrypt-cluster-traffic": "OFF",
        "wsrep_cluster_address": "gcomm://" + ",".join(f"{ip}:4567" for ip in FLEET["x"]),
    }


@pytest.mark.parametrize("limit", [3, 1_000_000])
@pytest.mark.parametrize("part_size", [2, 1000])
def test_settings_shared_by_a_cluster(members, clusters, part_size, limit):
    rows = m.instance_config(
        members, clusters, lists="shared", part_size=part_size, limit=limit
    ).collect()
    shared = [r for r in rows if r.instance is None]
    assert {r.cluster_id for r in shared} == {"g", "x", "o"}
    for cluster, key, port, scheme in (
        ("g", "group_replication_group_seeds", ":33061", ""),
        ("g", "group_replication_ip_allowlist", "", ""),
        ("x", "wsrep_cluster_address", ":4567", "gcomm://"),
    ):
        parts = sorted((r.part, r.value) for r in shared if (r.cluster_id, r.key) == (cluster, key))
        assert ",".join(v for _, v in parts) == scheme + ",".join(ip + port for ip in FLEET[cluster])
        assert [p for p, _ in parts] == list(range(-(-len(FLEET[cluster]) // part_size)))
    # Everything but the lists is the same as without sharing.
    lists = {"group_replication_group_seeds", "group_replication_ip_allowlist", "wsrep_cluster_address"}
    assert {r.key for r in shared} == lists
    plain = {(r.cluster_id, r.instance, r.key, r.value)
             for r in m.instance_config(members, clusters, lists="inline").collect() if r.key not in lists}
    assert {(r.cluster_id, r.instance, r.key, r.value) for r in rows if r.key not in lists} == plain


@pytest.mark.parametrize("lists", ["inline", "shared"])
def test_size_changes_neither_columns_nor_keys(spark, lists):
    """Ten and a thousand members get the same settings."""
    for kind in ("group-replication", "xtradb"):
        clusters = spark.createDataFrame([(1, kind)], "cluster_id int, kind string")
        found = []
        for size in (10, 1000):
            members = spark.range(size).selectExpr(
                "1 as cluster_id", "id as launch_ord", "concat('h', id) as private_ip"
            )
            df = m.instance_config(members, clusters, lists=lists)
            keys = {(r.instance is None, r.key) for r in df.select("instance", "key").distinct().collect()}
            found.append((df.schema, keys))
            per_member = df.where("instance is not null").groupBy("instance").count()
            assert per_member.count() == size
            assert per_member.select("count").distinct().count() == 1
            documents = m.manager_config(members)
            assert documents.where("json like '%RaftNodes%h9%'").count() == size
        assert found[0] == found[1]


def test_lists_are_shared_or_inline(members, clusters):
    with pytest.raises(ValueError, match="shared or inline"):
        m.instance_config(members, clusters, lists="both")


def test_given_group_name(members, clusters):
    from pyspark.sql import functions as F

    named = clusters.withColumn("name", F.concat(F.lit("uuid-"), "cluster_id"))
    got = settings_of(m.instance_config(members, named, group_name="name", lists="inline"))
    assert got["g", "10.1.0.1"]["group_replication_group_name"] == "uuid-g"


def test_status(members, clusters):
    got = {r.cluster_id: (r.members, r.status) for r in m.config_status(members, clusters).collect()}
    assert got == {
        "a": (3, "configured"), "g": (5, "configured"), "x": (4, "configured"),
        "s": (1, "single_member"), "o": (1, "configured"), "u": (2, "unknown_kind"),
        "d": (0, "no_members"),
    }


def test_manager_config(members):
    rows = {(r.cluster_id, r.instance): r for r in m.manager_config(members).collect()}
    document = json.loads(rows["a", "10.0.0.2"].json)
    assert document["RaftNodes"] == FLEET["a"]
    assert document["RaftBind"] == "10.0.0.2" and document["InstancePollSeconds"] == 5
    assert "DiscoverByShowSlaveHosts" not in document and len(document) == 15
    assert json.loads(rows["g", "10.1.0.1"].json)["RaftNodes"] == FLEET["g"]

from __future__ import annotations

import json

import pytest
from helpers import plan_of, rows_of
from pyspark.sql import functions as F

import moorage as m
from moorage.operators.inventory import DISCOVERY_SCHEMA, REQUEST_FIELDS, SERVICES_SCHEMA


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, json string")


def test_discovery_responses(spark):
    full = json.dumps({"rds_instances": [
        {"instance_id": "a", "port": 5_000_000_000, "engine": "E"}, {"instance_id": "b"},
    ]})
    df = docs(spark, "{}", '{"rds_instances":[]}', "{bad", full, None)
    found = m.discovered_instances(df, keep=["doc"]).select("doc", "instance_id", "port", "az")
    assert rows_of(found) == [(3, "a", 5_000_000_000, None), (3, "b", None, None)]
    assert [r.doc for r in m.malformed_documents(df, DISCOVERY_SCHEMA).collect()] == [2, 4]


def test_service_lists_are_walked_as_one(spark):
    text = json.dumps({
        "external": [{"service_id": "e", "group": "g"}],
        "mysql": [{"service_id": "m1", "port": 1, "custom_labels": {"k": "v"}}, {"service_id": "m2"}],
        "postgresql": [{"service_id": "p", "database_name": "d"}],
        "haproxy": [{"service_id": "h", "cluster": "c"}],
    })
    df = docs(spark, "{}", text, '{"mysql":null}', "{bad")
    rows = m.service_inventory(df)
    assert rows.columns[0] == "service_type" and rows.columns[-1] == "custom_labels"
    assert [(r.service_type, r.service_id) for r in rows.collect()] == [
        ("mysql", "m1"), ("mysql", "m2"), ("postgresql", "p"), ("haproxy", "h"), ("external", "e"),
    ]
    by_id = {r.service_id: r for r in rows.collect()}
    assert by_id["m1"].custom_labels == {"k": "v"} and by_id["m2"].custom_labels is None
    assert (by_id["p"].database_name, by_id["e"].group, by_id["h"].cluster) == ("d", "g", "c")
    assert m.malformed_documents(df, SERVICES_SCHEMA).count() == 1
    assert plan_of(rows).count("Scan ExistingRDD") == 1


def test_label_selection(spark):
    rows = [(1, {"resource_id": "o", "t": "x"}), (2, {"resource_id": "o"}), (3, None),
            (4, {"resource_id": "O", "t": "x"}), (5, {"resource_id": "p", "t": "x"})]
    df = spark.createDataFrame(rows, "id int, labels map<string,string>")
    pick = lambda *a, **k: [r.id for r in m.select_by_labels(df, *a, **k).collect()]
    assert pick({"t": "x"}, owner="o") == [1]
    assert pick({"resource_id": "p"}, owner="o") == [1, 2]
    assert pick({"t": "x"}) == [1, 4, 5]
    assert pick({}) == [1, 2, 3, 4, 5]


def test_tags(spark):
    df = spark.createDataFrame([(1, {"b": "2", "a": "1"}), (2, {}), (3, None)], "id int, labels map<string,string>")
    got = [r.tags for r in m.labels_to_tags(df).orderBy("id").collect()]
    assert got[0] == [("a", "1"), ("b", "2")] and got[1:] == [None, None]


def test_addresses_of_missing_elements_are_null(spark):
    kind = "array<struct<network_ip:string,access_configs:array<struct<nat_ip:string>>>>"
    df = spark.createDataFrame(
        [(1, [("10.1", [("34.1",), ("34.2",)]), ("10.2", [])]), (2, [("10.3", [])]),
         (3, [("10.4", None)]), (4, []), (5, None)],
        f"id int, network_interfaces {kind}",
    )
    got = m.project_addresses(df).select("id", "public_ip", "private_ip")
    assert rows_of(got) == [
        (1, "34.1", "10.1"), (2, None, "10.3"), (3, None, "10.4"), (4, None, None), (5, None, None),
    ]


def test_registration_requests(spark):
    df = spark.createDataFrame(
        [("r", "z", "a", "n", "h", 3306, "DISCOVER_RDS_MYSQL"),
         ("r", "z", "b", "n", "h", 5432, "DISCOVER_RDS_POSTGRESQL"),
         ("r", "z", "c", "n", "h", 1, "ORACLE"), ("r", "z", "d", "n", "h", 1, None)],
        "region string, az string, instance_id string, node_model string, address string, "
        "port bigint, engine string",
    )
    accepted, rejected = m.registration_requests(df, "owner", owner_label="own")
    assert accepted.columns == [name for name, _ in REQUEST_FIELDS] and len(REQUEST_FIELDS) == 25
    assert not {"password", "aws_access_key", "aws_secret_key", "agent_password"} & set(accepted.columns)
    first = accepted.orderBy("instance_id").first()
    assert first.service_name == "a" and first.custom_labels == {"own": "owner"}
    assert (first.tls, first.metrics_mode, first.tablestats_group_table_limit) == (False, 1, -1)
    assert rows_of(rejected.select("instance_id", "reason")) == [
        ("c", "engine ORACLE is not supported"), ("d", "engine  is not supported"),
    ]
    document = json.loads(m.registration_json(accepted.where("instance_id = 'a'")).first().json)
    assert document == {
        "region": "r", "az": "z", "instance_id": "a", "node_model": "n", "address": "h",
        "port": 3306, "engine": "DISCOVER_RDS_MYSQL", "service_name": "a", "username": "pmm",
        "rds_exporter": True, "qan_mysql_perfschema": True, "custom_labels": {"own": "owner"},
        "tablestats_group_table_limit": -1, "metrics_mode": 1, "qan_postgresql_pgstatements": True,
    }


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_lookup_takes_the_first_listed(spark, limit):
    instances = spark.createDataFrame(
        [(5, "a", "late"), (1, "a", "early"), (2, "b", None)],
        "ord int, instance_id string, address string",
    )
    requests = spark.createDataFrame(
        [(i, w) for i, w in enumerate(["a", "a", "a", "b", "A", None])],
        "request_id int, wanted_id string",
    )
    got = m.lookup_instance(requests, instances, columns=["address"], limit=limit)
    assert rows_of(got.select("request_id", "address", "status")) == [
        (0, "early", "found"), (1, "early", "found"), (2, "early", "found"), (3, None, "found"),
        (4, None, "not_found"), (5, None, "not_found"),
    ]


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_purge_keeps_unlabelled_services(spark, limit):
    services = spark.createDataFrame(
        [(1, {"resource_id": "o"}), (2, {"resource_id": "o"}), (3, {"resource_id": "o"}),
         (4, {"resource_id": "p"}), (5, {"x": "o"}), (6, None)],
        "service_id int, custom_labels map<string,string>",
    )
    owners = spark.createDataFrame([("o",), ("o",), ("q",), (None,)], "owner string")
    got = m.purge_by_owner(services, owners, limit=limit)
    assert got.columns == ["service_id", "custom_labels", "action"]
    assert [(r.service_id, r.action) for r in got.orderBy("service_id").collect()] == [
        (1, "remove"), (2, "remove"), (3, "remove"), (4, "keep"), (5, "keep"), (6, "keep"),
    ]

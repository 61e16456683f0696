"""Sources, sinks, streams and the chained jobs."""

from __future__ import annotations

import json
import os

import pytest
from helpers import plan_of, rows_of
from pyspark.sql import functions as F

import moorage as m
from moorage.plans import cluster_files, register_databases, report_telemetry
from moorage.sources import (
    read_configs,
    read_ini_documents,
    read_json_documents,
    read_package_listings,
    shared_folder,
    write_documents,
    write_json_documents,
)
from moorage.streaming import config_stream, run_to_files, telemetry_stream

CONFIGS = [
    {"config_id": "a", "resource": "ps", "instance_type": "t", "port": 0, "password": "hush"},
    {"config_id": "b", "resource": "pxc", "disable_telemetry": True},
    {"config_id": "", "resource": "pmm"},
    {"config_id": "d", "resource": "pmm", "volume_size": 5, "unknown": 1},
]


def write_lines(path, records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))


@pytest.fixture
def config_folder(tmp_path):
    folder = tmp_path / "configs"
    folder.mkdir()
    write_lines(folder / "1.json", CONFIGS[:2])
    write_lines(folder / "2.json", CONFIGS[2:])
    return folder


def test_stream_equals_batch_and_resumes(spark, config_folder):
    batch = rows_of(m.telemetry_metrics(m.reportable(read_configs(spark, str(config_folder)))))
    assert {r[0] for r in batch} == {"a", "d"} and "hush" not in {r[2] for r in batch}
    path, checkpoint = shared_folder(spark, "out"), shared_folder(spark, "state")

    def run():
        stream = telemetry_stream(
            config_stream(spark, str(config_folder), max_files_per_trigger=1)
        )
        query = run_to_files(stream, path, checkpoint)
        query.awaitTermination()
        assert all(not p.stateOperators for p in query.recentProgress)
        return rows_of(spark.read.parquet(path).select("config_id", "key", "value"))

    assert run() == batch
    write_lines(config_folder / "3.json", [{"config_id": "e", "resource": "ps", "version": "8"}])
    assert run() == sorted(batch + [
        ("e", "product", "terraform-provider"), ("e", "resource", "ps"), ("e", "version", "8"),
    ])


def test_stream_of_documents(spark, config_folder):
    configs = config_stream(spark, str(config_folder)).withColumn(
        "sent_at", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    path = shared_folder(spark, "documents")
    stream = telemetry_stream(configs, documents=True, sent_at="sent_at", version="9")
    run_to_files(stream, path, shared_folder(spark, "state"), file_format="json").awaitTermination()
    documents = [json.loads(r.json) for r in spark.read.json(path).collect()]
    assert sorted(d["metrics"]["id"] for d in documents) == ["a", "d"]


def test_telemetry_job(spark, config_folder, tmp_path):
    configs = read_configs(spark, str(config_folder)).withColumn(
        "sent_at", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    report = report_telemetry(configs)
    assert "Exchange" not in plan_of(report)
    write_json_documents(report, str(tmp_path / "out"))
    back = read_json_documents(spark, str(tmp_path / "out"))
    by_id = {}
    for r in back.collect():
        document = json.loads(r.json)["metrics"]
        by_id[document["id"]] = {x["key"]: x["value"] for x in document["metrics"]}
    assert by_id["a"]["port"] == "3306" and by_id["a"]["replication_type"] == "async"
    assert by_id["d"] == {"product": "terraform-provider", "resource": "pmm", "volume_size": "5"}


def test_shared_folder_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    path = shared_folder(spark, "x")
    assert path.startswith(before) and path != shared_folder(spark, "x")


def test_whole_file_sources(spark, tmp_path):
    folder = tmp_path / "listings"
    folder.mkdir()
    (folder / "server.txt").write_text("Version: 2\nVersion: 1\n")
    listing = m.package_index(read_package_listings(spark, str(folder)))
    assert rows_of(listing) == [("server.txt", 0, "2"), ("server.txt", 1, "1")]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    folder = tmp_path / "ini files"
    for host, port in (("h1", 1), ("h2", 2)):
        (folder / host).mkdir(parents=True)
        (folder / host / "my.cnf").write_text(f"[mysqld]\nport = {port}\n")
    rows = m.ini_rows(read_ini_documents(spark, str(folder)))
    documents = m.ini_documents(m.overlay_config([("base", rows)]))
    assert rows_of(documents) == [
        ("h1/my.cnf", 0, "[mysqld]\nport = 1\n"), ("h2/my.cnf", 0, "[mysqld]\nport = 2\n"),
    ]


def test_documents_need_a_key(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="key"):
        write_documents(df, str(tmp_path / "out"), [])
    write_documents(df, str(tmp_path / "out"), ["doc_id"])
    with pytest.raises(Exception, match="(?i)exists"):
        write_documents(df, str(tmp_path / "out"), ["doc_id"])
    write_documents(df, str(tmp_path / "out"), ["doc_id"], mode="overwrite")


def test_cluster_files(spark, tmp_path):
    members = spark.createDataFrame(
        [(1, i, f"10.0.0.{i}") for i in range(1, 4)] + [(2, 1, "10.1.0.1")],
        "cluster_id int, launch_ord int, private_ip string",
    )
    clusters = spark.createDataFrame([(1, "xtradb"), (2, "async")], "cluster_id int, kind string")
    files = cluster_files(members, clusters, base={"port": "1", "keep": "yes"}, monitored=False)
    texts = {r.doc_id: r.text for r in files.collect()}
    assert set(texts) == {"1/1", "1/2", "1/3", "2/1"}
    assert texts["2/1"] == "[mysqld]\nport = 1\nkeep = yes\n"
    assert texts["1/2"].startswith("[mysqld]\nport = 3306\nkeep = yes\n")
    assert "wsrep_cluster_address = gcomm://10.0.0.1:4567,10.0.0.2:4567" in texts["1/2"]
    shared = cluster_files(members, clusters, base={"keep": "yes"}, lists="shared", part_size=2)
    texts = {(r.doc_id, r.part): r.text for r in shared.collect()}
    assert set(texts) == {("1", 0), ("1", 1), ("1/1", 0), ("1/2", 0), ("1/3", 0), ("2/1", 0)}
    assert texts["1", 1] == "[mysqld]\nwsrep_cluster_address = 10.0.0.3:4567\n"
    write_documents(files, str(tmp_path / "files"), ["doc_id"])
    assert os.path.isdir(tmp_path / "files" / "doc_id=1%2F1")


def test_members_with_one_address_have_a_file_each(spark):
    members = spark.createDataFrame(
        [(1, 1, "10.0.0.1"), (1, 2, "10.0.0.1")], "cluster_id int, launch_ord int, private_ip string"
    )
    clusters = spark.createDataFrame([(1, "async")], "cluster_id int, kind string")
    files = cluster_files(members, clusters).collect()
    assert {(r.doc_id, r.address) for r in files} == {("1/1", "10.0.0.1"), ("1/2", "10.0.0.1")}
    assert sorted("server_id = 2" in r.text for r in files) == [False, True]


def test_registration_job(spark):
    discovery = spark.createDataFrame(
        [(1, json.dumps({"rds_instances": [
            {"instance_id": "db1", "region": "r", "port": 1, "engine": "DISCOVER_RDS_MYSQL"},
            {"instance_id": "db2", "engine": "ORACLE"},
        ]})), (2, "{bad")],
        "ord int, json string",
    )
    requests = spark.createDataFrame(
        [(1, "db1"), (2, "db2"), (3, "db3")], "request_id int, wanted_id string"
    )
    accepted, rejected = register_databases(discovery, requests, "me")
    row = accepted.first()
    assert accepted.count() == 1 and (row.request_id, row.instance_id) == (1, "db1")
    assert json.loads(row.json)["custom_labels"] == {"resource_id": "me"}
    assert rows_of(rejected) == [
        (2, "db2", "engine ORACLE is not supported"), (3, "db3", "not_found"),
    ]

"""Physical plans: what is pushed down, read, shuffled and broadcast."""

from __future__ import annotations

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

import moorage as m
from workload.queries import queries

ROW_WISE = [
    "telemetry_metrics", "telemetry_documents", "report_telemetry_documents", "validate_config",
    "apply_defaults", "compact_json", "package_index", "ini_rows", "discovered_instances",
    "service_inventory", "select_by_labels", "labels_to_tags", "project_addresses",
    "registration_requests", "parse_resource_names", "expected_resources", "normalize_endpoints",
]
JVM_ONLY_EXCEPT = {"fingerprint_rows", "fingerprint_texts"}


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_shuffle(name, spark, folder):
    plan = plan_of(queries()[name](spark, folder))
    assert "Exchange" not in plan and "Join" not in plan


def test_python_runs_only_for_the_hashes(spark, folder):
    for name, query in queries().items():
        if name == "telemetry_stream_metrics":
            continue
        plan = plan_of(query(spark, folder))
        assert ("EvalPython" in plan) == (name in JVM_ONLY_EXCEPT), name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "images")
    rows = [("f", 1, "v1", "READY", "x" * 50), ("f", 2, "v2", "PENDING", "y")]
    spark.createDataFrame(
        rows, "family string, ord int, name string, status string, notes string"
    ).write.parquet(path)
    plan = plan_of(m.latest_ready_image(spark.read.parquet(path)))
    assert "EqualTo(status,READY)" in plan
    assert "ReadSchema: struct<family:string,ord:int,name:string,status:string>" in plan


def test_lookups_without_a_heavy_key_are_one_plain_join(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.range(10).select(
        F.col("id").alias("request_id"), F.lit("a").alias("wanted_id"), F.lit("n").alias("note")
    ).write.parquet(path)
    instances = spark.createDataFrame([(1, "a", "r", "h", 1, "E")],
        "ord int, instance_id string, region string, address string, port int, engine string")
    plan = plan_of(m.lookup_instance(spark.read.parquet(path), instances))
    assert plan.count("FileScan") == 1 and plan.count("Join") == 1


def test_numbering_reads_and_shuffles_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "members")
    spark.range(100).select(
        (F.col("id") % 3).alias("cluster_id"), F.col("id").alias("launch_ord"),
        F.lit("wide").alias("public_ip"),
    ).write.parquet(path)
    plan = plan_of(m.assign_roles(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1

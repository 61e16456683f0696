from __future__ import annotations

import datetime
import json

import pytest
from helpers import plan_of, rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

import moorage as m
from moorage.functions.values import rfc3339, seconds_text

FILLER = {"string": "somestring", "int": 1234, "boolean": True, "double": 1234.56}

MACHINE_KEYS = {
    "vpc_name": "somestring", "key_pair_name": "somestring", "volume_type": "somestring",
    "vpc_id": "somestring", "instance_type": "somestring", "volume_size": "20",
    "volume_iops": "1234", "volume_throughput": "1234",
}
DATABASE_KEYS = MACHINE_KEYS | {
    "version": "somestring", "config_file_path": "somestring", "pmm_address": "somestring",
    "cluster_size": "3", "port": "3306",
}
EXPECTED = {
    "ps": DATABASE_KEYS | {"replication_type": "async"},
    "pxc": DATABASE_KEYS | {"galera_port": "4567"},
    "pmm": MACHINE_KEYS,
}


def filled_record(spark, resource, fill=True):
    """A record of the kind's fields, each set to its default or to a filler of its type."""
    fields = [f for f in m.FIELDS if resource in f.resources and not f.computed]
    schema = T.StructType.fromDDL(
        "config_id string, resource string, " + ", ".join(f"{f.name} {f.type}" for f in fields)
    )
    values = [
        None if not fill else f.default if f.default is not None else FILLER[f.type]
        for f in fields
    ]
    return spark.createDataFrame([("id", resource, *values)], schema)


@pytest.mark.parametrize("resource, size", [("ps", 16), ("pxc", 16), ("pmm", 10)])
def test_metrics_of_a_filled_record(spark, resource, size):
    got = {r.key: r.value for r in m.telemetry_metrics(filled_record(spark, resource)).collect()}
    assert got == EXPECTED[resource] | {"product": "terraform-provider", "resource": resource}
    assert len(got) == size


@pytest.mark.parametrize("resource", ["ps", "pxc", "pmm"])
def test_document_of_an_empty_record(spark, resource):
    now = datetime.datetime(2024, 5, 6, 7, 8, 9, 120_000, datetime.timezone.utc)
    record = filled_record(spark, resource, fill=False).withColumn("sent_at", F.lit(now))
    text = m.telemetry_documents(record, version="test-ver").first().json
    assert json.loads(text) == {
        "metrics": {
            "id": "id",
            "time": "2024-05-06T07:08:09.12Z",
            "pmmServerTelemetryId": "x" * 22,
            "pmmServerVersion": "test-ver",
            "upDuration": "0.673692200s",
            "distributionMethod": "DOCKER",
            "metrics": [
                {"key": "product", "value": "terraform-provider"},
                {"key": "resource", "value": resource},
            ],
        }
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_text_does_not_depend_on_the_session(spark, zone):
    micros = {0: "", 120_000: ".12", 123_000: ".123", 123_456: ".123456"}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        # 2024-03-10 07:00 UTC lies in New York's spring gap.
        base = 1_710_054_000_000_000
        df = spark.createDataFrame([(base + u,) for u in micros], "u bigint").select(
            F.timestamp_micros("u").alias("t")
        )
        texts = [r[0] for r in df.select(rfc3339(F.col("t"), T.TimestampType())).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert texts == [f"2024-03-10T07:00:00{fraction}Z" for fraction in micros.values()]


def test_duration_text(spark):
    df = spark.createDataFrame([(0.0,), (0.6736922,), (12.5,)], "s double")
    texts = [r[0] for r in df.select(seconds_text(F.col("s"))).collect()]
    assert texts == ["0.000000000s", "0.673692200s", "12.500000000s"]


def test_secrets_and_user_info_stay_out(spark):
    record = filled_record(spark, "ps").withColumns(
        {"password": F.lit("hush"), "pmm_address": F.lit("http://admin:p@ss@host:80/x@y")}
    )
    values = {r.key: r.value for r in m.telemetry_metrics(record).collect()}
    assert "hush" not in values.values()
    assert values["pmm_address"] == "http://host:80/x@y"
    plain = m.telemetry_metrics(record, redact_urls=False)
    assert ("pmm_address", "http://admin:p@ss@host:80/x@y") in [
        (r.key, r.value) for r in plain.collect()
    ]


def test_address_is_secret_for_one_kind_only(spark):
    record = filled_record(spark, "pmm_rds")
    assert {r.key for r in m.telemetry_metrics(record).collect()} == {
        "product", "resource", "rds_id", "rds_username",
    }


def test_opt_out_and_empty_id_send_nothing(spark):
    df = spark.createDataFrame(
        [("a", False), ("b", True), ("", False), (None, False), ("c", None)],
        "config_id string, disable_telemetry boolean",
    )
    assert sorted(r.config_id for r in m.reportable(df).collect()) == ["a", "c"]


def test_metrics_need_no_shuffle_and_read_few_columns(spark, folder):
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    config = customers.select(
        F.col("c_custkey").alias("config_id"),
        F.lit("ps").alias("resource"),
        F.col("c_mktsegment").alias("instance_type"),
        F.col("c_name").alias("password"),
    )
    plan = plan_of(m.telemetry_metrics(config))
    assert "Exchange" not in plan and "Join" not in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_catalog_frame_hides_secret_defaults(spark):
    frame = m.catalog_frame(spark)
    assert frame.count() == 59
    assert frame.where("sensitive and default is not null").count() == 0
    assert rows_of(frame.where("field = 'port'").select("resource", "default")) == [
        ("ps", "3306"), ("pxc", "3306"),
    ]

from __future__ import annotations

import pytest

import moorage as m

SCHEMA = (
    "config_id int, resource string, cloud string, key_pair_name string, instance_type string, "
    "version string, replication_type string, orchestrator_size int"
)


def errors_of(spark, strict=False, **changes):
    record = {
        "config_id": 1, "resource": "ps", "cloud": "aws", "key_pair_name": "k",
        "instance_type": "t", "version": "8.0", "replication_type": "async",
        "orchestrator_size": 0,
    } | changes
    df = spark.createDataFrame([tuple(record.values())], SCHEMA)
    return m.validate_config(df, strict=strict).first().errors


@pytest.mark.parametrize(
    "version, errors",
    [
        ("8", []), ("8.0", []), ("8.0.28", []), ("8.0.28-19", []), ("8.0.28-19-1.focal+b", []),
        (None, []), ("08", ["version_invalid"]), ("8.x", ["version_invalid"]),
        ("8-1", ["version_invalid"]), ("8.0.28-01", ["version_invalid"]),
        ("8.0.28\n", ["version_invalid"]), ("", ["version_empty"]),
    ],
)
def test_version(spark, version, errors):
    assert errors_of(spark, version=version) == errors


@pytest.mark.parametrize("size, wrong", [(-1, False), (0, False), (1, True), (2, True), (3, False)])
def test_manager_size(spark, size, wrong):
    expected = ["orchestrator_size_too_small"] if wrong else []
    assert errors_of(spark, orchestrator_size=size) == expected
    strict = ["orchestrator_size_negative"] if size < 0 else expected
    assert errors_of(spark, strict=True, orchestrator_size=size) == strict


def test_other_rules(spark):
    assert errors_of(spark, cloud="azure") == ["cloud_unsupported"]
    assert errors_of(spark, cloud=None) == ["cloud_unsupported"]
    assert errors_of(spark, key_pair_name="") == ["missing_key_pair_name"]
    assert errors_of(spark, replication_type="semi") == ["replication_type_unsupported"]
    # The kind does not have these fields.
    assert errors_of(spark, resource="pmm", version="x", replication_type="semi") == []


def test_a_missing_column_is_missing_everywhere(spark):
    df = spark.createDataFrame([("ps", "aws")], "resource string, cloud string")
    assert m.validate_config(df).first().errors == ["missing_key_pair_name", "missing_instance_type"]


def test_defaults(spark):
    df = spark.createDataFrame(
        [
            ("ps", "aws", "", 0, 0, "", None, "async"),
            ("pmm", "gcp", "", 0, 5, "", None, ""),
            ("pxc", "gcp", "ssd", 7, 0, "net", 99, ""),
            ("ps", "gcp", None, 7, 0, "default", 99, ""),
        ],
        "resource string, cloud string, volume_type string, volume_size int, volume_iops int, "
        "vpc_name string, port int, replication_type string",
    )
    got = [tuple(r)[2:] for r in m.apply_defaults(df).collect()]
    assert got == [
        ("gp2", 20, None, "", 3306, "async", None),
        ("pd-balanced", 20, 5, "default", None, "", "default"),
        ("ssd", 7, None, "net", 99, "", "net-sub"),
        ("pd-balanced", 7, None, "default", 99, "async", "default"),
    ]

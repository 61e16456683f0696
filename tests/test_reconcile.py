from __future__ import annotations

import datetime

import pytest
from helpers import plan_of, rows_of
from pyspark.sql import functions as F

import moorage as m



def test_resource_names(spark):
    arns = ["arn:aws:ec2:r:1:vpc", "x", None, "arn:aws:ec2:r:vpc/v", "arn:aws:ec2:r:1:vpc/v-1",
            "arn:aws:ec2:r:1:a/b/c", "arn:aws:ec2:r:1:a:b/c:d", "arn:::::/x"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arns)], "ord int, arn string")
    got = m.parse_resource_names(df).orderBy("ord").select("type", "id", "reason")
    assert [tuple(r) for r in got.collect()] == [
        (None, None, "no_id"), (None, None, "not_an_arn"), (None, None, "not_an_arn"),
        (None, None, "not_an_arn"), ("vpc", "v-1", None), ("a", "b", None), ("a:b", "c:d", None),
        ("", "x", None),
    ]


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_ids_come_whole_in_ordered_batches(spark, limit):
    rows = [(i * 2, "instance", f"i-{i}") for i in range(95)]
    rows += [(i * 3 + 1, "vpc", f"v-{i}") for i in range(4)] + [(9, "odd", "o"), (11, None, None)]
    df = spark.createDataFrame(rows, "ord int, type string, id string").repartition(4)
    got = m.group_resource_ids(df, batch=20, limit=limit).orderBy("delete_rank", "batch").collect()
    assert [(r.type, r.delete_rank, r.batch, r.n) for r in got] == [
        ("odd", None, 0, 1), *[("instance", 1, b, 20) for b in range(4)],
        ("instance", 1, 4, 15), ("vpc", 6, 0, 4),
    ]
    ids = [i for r in got if r.type == "instance" for i in r.ids]
    assert ids == [f"i-{i}" for i in range(95)]


@pytest.fixture(scope="module")
def actual(spark):
    return spark.createDataFrame(
        [(3, "v-3", "net", "k1"), (1, "v-1", "net", "k2"), (2, "v-2", "", "k1"), (4, "v-4", "lone", None)],
        "ord int, act_id string, act_name string, content string",
    )


DESIRED = [
    (1, "v-3", "lone", "k1"),   # the id wins over the name
    (2, "v-9", "net", "k2"),    # the id misses, the first of that name
    (3, "", "net", "k1"),       # content differs
    (4, "", "", "k1"),          # nothing to try
    (5, None, None, None),
    (6, "v-2", "", None),       # existing, but not known here
    (7, "", "lone", "k"),
]


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_reconcile(spark, actual, limit):
    desired = spark.createDataFrame(
        DESIRED, "desired_id int, want_id string, want_name string, content string"
    )
    got = m.reconcile_resources(desired, actual, compare="content", limit=limit)
    assert got.count() == len(DESIRED)
    assert rows_of(got.select("desired_id", "match_ord", "matched_by", "action")) == [
        (1, 3, "id", "reuse"), (2, 1, "name", "reuse"), (3, 1, "name", "conflict"),
        (4, None, None, "create"), (5, None, None, "create"), (6, 2, "id", "missing_local"),
        (7, 4, "name", "conflict"),
    ]
    plain = m.reconcile_resources(desired, actual, limit=limit)
    assert {r.action for r in plain.collect()} == {"reuse", "create"}
    assert m.orphaned_resources(actual, got).count() == 0
    some = got.where("desired_id <= 3")
    assert [r.ord for r in m.orphaned_resources(actual, some).orderBy("ord").collect()] == [2, 4]


def test_expected_names(spark):
    df = spark.createDataFrame(
        [("v1", "net", "aws"), ("v2", "", "aws"), ("v3", "net", "gcp"), ("v4", "default", "gcp"),
         ("v5", None, "gcp"), ("v6", "net", "other")],
        "vpc_id string, vpc_name string, cloud string",
    )
    names = {}
    for r in m.expected_resources(df, keep=("vpc_id",)).collect():
        names.setdefault(r.vpc_id, {})[r.kind] = r.name
    assert names == {
        "v1": {"internet-gateway": "net-igw", "security-group": "net-sg", "subnet": "net-subnet",
               "route-table": "net-rtb"},
        "v2": {"internet-gateway": None, "security-group": "v2-sg", "subnet": None,
               "route-table": None},
        "v3": {"network": "net", "subnetwork": "net-sub", "firewall": "net-allow-all"},
        "v4": {"network": "default", "subnetwork": "default", "firewall": "default-allow-all"},
        "v5": {"network": "default", "subnetwork": "default", "firewall": "default-allow-all"},
    }
    assert "Join" not in plan_of(m.expected_resources(df))


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_image_times_do_not_depend_on_the_session(spark, zone):
    """Over the hours that a clock change skips or repeats."""
    rows = [("spring", 1, "2024-03-31T02:45:00.000Z", "a", "l1"), ("spring", 2, "2024-03-31T03:15:00.000Z", "b", "l2"),
            ("autumn", 1, "2024-11-03T05:30:00.000Z", "a", "l1"), ("autumn", 2, "2024-11-03T06:15:00.000Z", "b", "l2"),
            ("bad", 1, "2024-03-31T02:45:00.000", "a", "l1"), ("bad", 2, "soon", "b", "l2")]
    df = spark.createDataFrame(rows, "family string, ord int, created string, name string, link string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = {r.family: (r.name, r.link) for r in m.latest_image(df, keep=["link"]).collect()}
        undated = m.undated_images(df).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == {"spring": ("b", "l2"), "autumn": ("b", "l2")} and undated == 2


def test_latest_image(spark):
    rows = [
        ("f", 2, "2024-01-01T00:00:00.000Z", "b"), ("f", 1, "2024-01-01T00:00:00.000Z", "a"),
        ("f", 0, "2023-12-31T23:59:59.999Z", "c"), ("f", 3, "soon", "d"), ("g", 4, "never", "e"),
    ]
    df = spark.createDataFrame(rows, "family string, ord int, created string, name string")
    assert rows_of(m.latest_image(df).select("family", "ord", "name")) == [("f", 1, "a")]
    assert rows_of(m.undated_images(df).select("ord")) == [(3,), (4,)]
    typed = df.where("ord < 3").withColumn("created", F.lit(datetime.datetime(2024, 1, 1)))
    assert m.latest_image(typed).first().ord == 0


def test_latest_ready_image(spark):
    df = spark.createDataFrame(
        [("f", 5, "v2", "READY"), ("f", 3, "v2", "READY"), ("f", 1, "v10", "READY"),
         ("f", 0, "v9", "PENDING"), ("g", 7, "v1", "PENDING"), ("h", 8, "v1", None)],
        "family string, ord int, name string, status string",
    )
    assert rows_of(m.latest_ready_image(df)) == [("f", 3, "v2")]

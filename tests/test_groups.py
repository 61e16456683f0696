"""Heavy groups: the split routes give what the plain ones do."""

from __future__ import annotations

import random

import pytest
from helpers import plan_of, rows_of
from pyspark.sql import functions as F

from moorage.operators.groups import first_by, heavy_groups, lookup, numbered, sliced

pytestmark = pytest.mark.usefixtures("small_slices")


@pytest.fixture(scope="module")
def skewed():
    """(key, ord): one key holds more than a third of the rows; positions have gaps."""
    rng = random.Random(7)
    rows = [("hot", position * 3) for position in range(400)]
    for key in range(60):
        rows += [(f"k{key}", o) for o in rng.sample(range(10_000), rng.randint(1, 20))]
    rng.shuffle(rows)
    return rows


def brute_positions(rows):
    groups = {}
    for key, position in rows:
        groups.setdefault(key, []).append(position)
    return sorted(
        (key, o, i + 1, len(found))
        for key, found in groups.items()
        for i, o in enumerate(sorted(found))
    )


@pytest.mark.parametrize("limit", [1, 5, 37, 400, 1_000_000])
def test_numbered_equals_brute_force(spark, skewed, limit):
    df = spark.createDataFrame(skewed, "key string, ord bigint").repartition(5)
    result = numbered(df, ["key"], "ord", limit).select("key", "ord", "pos", "n")
    assert sorted(tuple(r) for r in result.collect()) == brute_positions(skewed)


@pytest.mark.parametrize("positions", ["sparse", "full range", "equal"])
def test_numbered_over_odd_positions(spark, positions):
    """A heavy group is cut by its rows, not by the span of its positions."""
    rng = random.Random(3)
    if positions == "sparse":
        orders = sorted({rng.randint(-(1 << 62), 1 << 62) for _ in range(500)})
    elif positions == "full range":
        orders = [-(1 << 63), (1 << 63) - 1] + rng.sample(range(1 << 60), 300)
    else:
        orders = [5] * 300
    rows = [("hot", o, i) for i, o in enumerate(orders)] + [("cold", 1, 0)]
    df = spark.createDataFrame(rows, "key string, ord bigint, tie int").repartition(4)
    found = numbered(df, ["key"], ["ord", "tie"], 20).where("key = 'hot'").collect()
    assert [(r.ord, r.tie) for r in sorted(found, key=lambda r: r.pos)] == sorted(
        (o, t) for k, o, t in rows if k == "hot"
    )
    assert sorted(r.pos for r in found) == list(range(1, len(orders) + 1))
    assert {r.n for r in found} == {len(orders)}


def test_slices_share_the_rows_evenly(spark):
    rng = random.Random(3)
    rows = [("hot", o) for o in rng.sample(range(1 << 60), 4000)]
    df = spark.createDataFrame(rows, "key string, ord bigint")
    sizes = [r["count"] for r in sliced(df, ["key"], ["ord"], 16).groupBy("slice").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4 * 4000 / 16


def test_group_columns_come_along(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, ord bigint")
    groups = spark.createDataFrame([("hot", 1), ("k3", 2)], "key string, mark int")
    for limit in (30, 1_000_000):
        found = numbered(df, ["key"], "ord", limit, groups)
        marks = {(r.key, r.mark) for r in found.select("key", "mark").distinct().collect()}
        assert {("hot", 1), ("k3", 2), ("k4", None)} <= marks
        assert found.count() == len(skewed)


def test_numbered_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(9)] + [("a", 1)], "key string, ord bigint")
    result = numbered(df, ["key"], "ord", 2).select("key", "ord", "pos", "n")
    assert rows_of(result)[-1] == (None, 8, 9, 9)
    assert result.count() == 10


def test_order_must_be_a_position(spark):
    df = spark.createDataFrame([("a", "x")], "key string, ord string")
    with pytest.raises(ValueError, match="listing position"):
        numbered(df, ["key"], "ord")


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_lookup_equals_brute_force(spark, skewed, limit):
    left_rows = [(i, key if i % 5 else None) for i, (key, _) in enumerate(skewed)]
    right = {f"k{i}": i for i in range(0, 60, 2)} | {"hot": -1}
    left = spark.createDataFrame(left_rows, "id bigint, key string")
    table = spark.createDataFrame(list(right.items()), "key string, value bigint")
    result = lookup(left, table, ["key"], ["id"], limit).select("id", "key", "value")
    expected = sorted((i, k, right.get(k)) for i, k in left_rows)
    assert sorted(tuple(r) for r in result.collect()) == expected


def test_lookup_spreads_a_heavy_key(spark):
    left = spark.range(10_000).select("id", F.lit("hot").alias("key"))
    right = spark.createDataFrame([("hot", 1)], "key string, value int")
    with_hint_off = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                     "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                     "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in with_hint_off}
    try:
        for k, v in with_hint_off.items():
            spark.conf.set(k, v)
        joined = lookup(left, right, ["key"], ["id"], limit=100)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(
            F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == 10_000
    assert len(sizes) == 8 and max(sizes) < 10_000 / 3


def test_heavy_keys_are_found(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, ord bigint")
    assert [tuple(r) for r in heavy_groups(df, ["key"], 100).collect()] == [("hot", 400)]


def test_first_by_combines_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, ord bigint")
    plan = plan_of(first_by(df, ["key"], "ord", "ord"))
    assert plan.index("partial_min_by") > plan.index("Exchange")

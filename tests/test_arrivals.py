"""Numbers that stay when members arrive, leave and come in any order."""

from __future__ import annotations

import random

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

import moorage as m

pytestmark = pytest.mark.usefixtures("small_slices")

SCHEMA = "cluster_id bigint, launch_ord bigint, public_ip string, high int, note string"
ROLES = ["cluster_id", "launch_ord", "server_id"]


def frame(spark, members):
    return spark.createDataFrame([(c, o, f"ip{o}", 7, "x") for c, o in members], SCHEMA)


def brute(loads):
    """(cluster, position) to number, load by load, with a counter per cluster."""
    given, counters = {}, {}
    for load in loads:
        for key in sorted(load):
            if key not in given:
                counters[key[0]] = counters.get(key[0], 0) + 1
                given[key] = counters[key[0]]
    return given


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_loads_equal_counting(spark, limit):
    """One cluster holds most members; some leave, some come back, positions fall in between."""
    rng = random.Random(2)
    every = [(rng.choice([1, 1, 1, 2, 3, 4]), o) for o in rng.sample(range(500), 120)]
    loads = [rng.sample(every, n) for n in (30, 60, 90)]
    known, marks, present = None, None, None
    for load in loads:
        df = frame(spark, load)
        if known is None:
            now = m.assign_roles(df, limit=limit)
        else:
            now = m.assign_new_roles(df, known, marks=marks, limit=limit)
        marks = spark.createDataFrame(m.high_marks(now, marks=marks).collect(), "cluster_id bigint, high bigint")
        present = now.collect()
        rows = [tuple(r) for r in now.select(*ROLES).collect()]
        before = [] if known is None else [tuple(r) for r in known.collect()]
        known = spark.createDataFrame(sorted({*before, *rows}), "cluster_id bigint, launch_ord bigint, server_id bigint")
    want = brute(loads)
    assert {(r.cluster_id, r.launch_ord): r.server_id for r in present} == {k: want[k] for k in loads[-1]}
    assert all(r.is_replica == (r.server_id > 1) and r.bootstrap == (r.server_id == 1) for r in present)


def test_two_loads_equal_one_when_positions_rise(spark):
    members = [(c, o) for o in range(40) for c in [o % 3]]
    first = m.assign_roles(frame(spark, members[:17]))
    both = m.assign_new_roles(frame(spark, members), first)
    assert rows_of(both) == rows_of(m.assign_roles(frame(spark, members)))


def test_numbers_of_those_who_left_are_not_given_again(spark):
    first = m.assign_roles(frame(spark, [(1, 10), (1, 20), (1, 30)]))
    left, marks = first.where("launch_ord < 30"), m.high_marks(first)
    arrivals = frame(spark, [(1, 10), (1, 20), (1, 5), (2, 1)])
    numbers = lambda **options: [tuple(r) for r in m.assign_new_roles(arrivals, left, **options)
                                 .orderBy("cluster_id", "server_id").select(*ROLES).collect()]
    assert numbers(marks=marks) == [(1, 10, 1), (1, 20, 2), (1, 5, 4), (2, 1, 1)]
    assert numbers() == [(1, 10, 1), (1, 20, 2), (1, 5, 3), (2, 1, 1)]


def test_several_member_columns_null_keys_and_empty_tables(spark):
    df = frame(spark, [(1, 1), (1, 2), (None, 3), (None, 4)]).withColumn("name", F.concat(F.lit("m"), "launch_ord"))
    first = m.assign_new_roles(df, m.assign_roles(df).limit(0), member=["launch_ord", "name"])
    assert sorted(r.server_id for r in first.collect()) == [1, 1, 2, 2]
    again = m.assign_new_roles(df, first, member=["launch_ord", "name"])
    assert rows_of(again) == rows_of(first) and again.columns == [*df.columns, "server_id", "is_replica", "bootstrap", "manager_url"]
    assert m.assign_new_roles(df.limit(0), first, member=["launch_ord", "name"]).count() == 0

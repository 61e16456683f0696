"""Many selectors at once, against looking every machine through for every selector."""

from __future__ import annotations

import random

import pytest
from helpers import plan_of, rows_of

import moorage as m

MACHINES = "machine_id bigint, labels map<string,string>, _key string, _value string"
SELECTORS = "selector_id bigint, wanted map<string,string>, owner string, _pairs int"


def brute(machines, selectors):
    out = []
    for selector, wanted, owner in selectors:
        pairs = dict(wanted or {})
        if owner is not None:
            pairs["resource_id"] = owner
        if pairs:
            out += [(selector, machine) for machine, labels in machines
                    if all(v is not None and (labels or {}).get(k) == v for k, v in pairs.items())]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def found(spark, machines, selectors, **options):
    df = spark.createDataFrame([(*row, "x", "y") for row in machines], MACHINES).repartition(3)
    asked = spark.createDataFrame([(*row, 1) for row in selectors], SELECTORS)
    return rows_of(m.match_selectors(df, asked, owner="owner", **options))


@pytest.fixture(scope="module")
def fleet():
    rng = random.Random(1)
    names = ["role", "zone", "tier", "resource_id", "rack"]
    some = lambda: {k: f"v{rng.randint(0, 3)}" for k in rng.sample(names, rng.randint(0, 5))}
    # Nearly all machines hold one pair, which is all that some selectors ask for.
    machines = [(i, {**some(), **({"site": "a"} if i % 10 else {})}) for i in range(300)]
    machines += [(5, machines[5][1]), (None, {"site": "a"}), (400, None), (401, {}), (402, {"role": None, "zone": "v1"})]
    selectors = [(i, {k: v for k, v in some().items() if rng.random() < 0.6}, rng.choice([None, None, "v1"])) for i in range(60)]
    selectors += [(100, {"site": "a"}, None), (101, {"site": "a", "role": "v1"}, None), (102, {}, None), (103, None, None),
                  (104, None, "v2"), (105, {"resource_id": "v0"}, "v1"), (106, {"role": None}, None),
                  (107, {"role": "v1", "site": "never"}, None), (108, {"no": "such"}, None)]
    return machines, selectors


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_selectors_equal_brute_force(spark, fleet, limit):
    """Also where the machines of a frequent pair are dealt out."""
    want = brute(*fleet)
    assert found(spark, *fleet, limit=limit) == want and len(want) > 500


def test_empty_tables(spark, fleet):
    assert found(spark, [], fleet[1]) == [] and found(spark, fleet[0], []) == []


def test_only_pairs_meet(spark, fleet):
    """No cross join, and the machines are looked up by one pair of a selector only."""
    df = spark.createDataFrame([(*row, "x", "y") for row in fleet[0]], MACHINES)
    asked = spark.createDataFrame([(*row, 1) for row in fleet[1]], SELECTORS)
    plan = plan_of(m.match_selectors(df, asked, owner="owner"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_equal_selectors_and_machines_meet_in_blocks(spark, fleet, monkeypatch):
    """What meets grows with the distinct label sets, not with the machines times the selectors."""
    from moorage.operators import selectors

    tables, write = {}, selectors.written
    monkeypatch.setattr(selectors, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    machines = [(i, {"site": "a", "zone": f"z{i % 3}"}) for i in range(1200)] + [(7, {"site": "a", "zone": "z1"})]
    wishes = [(i, {"zone": f"z{i % 4}"}, None) for i in range(40)]
    assert found(spark, machines, wishes) == brute(machines, wishes)
    assert tables["machine-blocks"].count() == 3 and tables["selector-blocks"].count() == 3

    tables.clear()
    monkeypatch.setattr(selectors, "_BLOCK_IDS", 7)
    monkeypatch.setattr(selectors, "_TASK_PAIRS", 100)
    assert found(spark, machines, wishes) == brute(machines, wishes)
    assert tables["machine-blocks"].count() == 3 * 58 and max(r._shares for r in tables["pair-shares"].collect()) > 10
    tables.clear()
    assert found(spark, *fleet) == brute(*fleet)

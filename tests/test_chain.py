"""The get-or-create chain, against serving the requests one after the other."""

from __future__ import annotations

import random

import pytest
from helpers import plan_of, rows_of

import moorage as m

REQUESTS = "request_id bigint, request_ord bigint, want_id string, want_name string"
NETWORKS = "ord bigint, act_id string, act_name string"
RESOURCES = "ord bigint, kind string, act_id string, act_name string, network_id string, default_route boolean"
SUFFIXES = {"internet-gateway": "-igw", "security-group": "-sg", "subnet": "-subnet", "route-table": "-rtb"}


def served(requests, networks, resources):
    """What each request gets or creates, with a store that the requests before it have changed."""
    networks = [{"id": i, "name": n, "by": None} for _, i, n in sorted(networks)]
    resources = [dict(zip(("kind", "id", "name", "network", "route"), r[1:]), by=None) for r in sorted(resources, key=lambda r: r[0])]
    out = []
    for request, _, want_id, want_name in sorted(requests, key=lambda r: r[1]):
        def report(kind, name, one):
            action = "reuse" if one["by"] is None else "create" if one["by"] == request else "reuse_created"
            out.append((request, kind, name, action, one["id"] if one["by"] is None else None, one["by"]))

        first = lambda rows, test: next((row for row in rows if test(row)), None)
        net = (want_id and first(networks, lambda n: n["id"] == want_id)) or None
        if net is None and want_name:
            net = first(networks, lambda n: n["name"] == want_name)
        if net is None:
            net = {"id": f"new-{request}", "name": want_name or "", "by": request}
            networks.append(net)
        report("vpc", net["name"] or None, net)
        for kind, suffix in SUFFIXES.items():
            name = net["name"] + suffix if net["name"] else None
            if kind == "security-group":
                own = name or net["id"] + suffix
                one = first(resources, lambda r: r["kind"] == kind and r["name"] == own)
                shown = own if name or net["by"] is None else None
            else:
                one = first(
                    resources,
                    lambda r: r["kind"] == kind and r["network"] == net["id"] and (name is None or r["name"] == name)
                    and (kind != "route-table" or r["route"]),
                )
                own = shown = name
            if one is None:
                one = {"kind": kind, "id": "new", "name": own or "", "network": net["id"], "route": True, "by": request}
                resources.append(one)
            report(kind, shown, one)
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def chained(spark, requests, networks, resources, **options):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((requests, REQUESTS), (networks, NETWORKS), (resources, RESOURCES))]
    return m.reconcile_chain(*frames, **options)


def fleet(seed, size=60):
    rng = random.Random(seed)
    kinds = list(SUFFIXES)
    networks = [(i, f"v{i}", rng.choice(["", f"n{rng.randint(0, 8)}"])) for i in range(12)]
    requests = [
        (i, order, rng.choice(["", None, f"v{rng.randint(0, 16)}"]), rng.choice(["", None, f"n{rng.randint(0, 14)}"]))
        for i, order in enumerate(rng.sample(range(1000), size))
    ]
    resources = []
    for i in range(40):
        kind, net = rng.choice(kinds), rng.choice(networks)
        name = rng.choice(["", None, net[2] + SUFFIXES[kind], f"n{rng.randint(0, 14)}" + SUFFIXES[kind], net[1] + SUFFIXES[kind]])
        resources.append((i, kind, f"r{i}", name, rng.choice([net[1], net[1], None]), rng.choice([True, True, False, None])))
    return requests, networks, resources


@pytest.mark.parametrize(("seed", "limit"), [(0, 1_000_000), (1, 1_000_000), (2, 3)])
def test_chain_equals_serving_in_turn(spark, seed, limit):
    found = fleet(seed)
    assert rows_of(chained(spark, *found, limit=limit)) == served(*found)


def test_a_new_network_forces_its_children(spark):
    requests = [(1, 1, "", "a"), (2, 2, "", "a"), (3, 3, "", "")]
    resources = [(1, "subnet", "r1", "a-subnet", "v1", True), (2, "security-group", "r2", "a-sg", "v1", True)]
    rows = {(r[0], r[1]): r[3:] for r in rows_of(chained(spark, requests, [(1, "v1", "b")], resources))}
    assert rows[1, "vpc"] == ("create", None, 1) and rows[2, "vpc"] == ("reuse_created", None, 1)
    assert rows[1, "subnet"] == ("create", None, 1) and rows[2, "subnet"] == ("reuse_created", None, 1)
    # A group goes by its name alone, in whatever network it is.
    assert rows[1, "security-group"] == ("reuse", "r2", None)
    assert rows[3, "vpc"] == rows[3, "subnet"] == ("create", None, 3)


def test_empty_tables(spark):
    requests, networks, resources = fleet(9, 5)
    assert rows_of(chained(spark, [], networks, resources)) == []
    assert rows_of(chained(spark, requests, [], [])) == served(requests, [], [])


def test_no_pairs_but_equal_keys(spark):
    plan = plan_of(chained(spark, *fleet(1)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan

from __future__ import annotations

import random
import re

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

import moorage as m
from moorage.functions import semver

LISTING = ["8.0.30-22-1", "8.0.28-20-1", "8.0.28-19-1", "5.7.1-1"]


@pytest.mark.parametrize(
    "wanted, version, status",
    [
        ("8", "8.0.30-22-1", "found"),
        ("5.7", "5.7.1-1", "found"),
        ("8.0.28", "8.0.28-20-1", "found"),
        ("8.0.28-19", None, "not_found"),
        ("8.0.28-19-1", "8.0.28-19-1", "found"),
        ("9", None, "not_found"),
        ("x", None, "invalid"),
        (None, "8.0.30-22-1", "default"),
        ("", "8.0.30-22-1", "default"),
    ],
)
def test_listed_cases(spark, wanted, version, status):
    listing = spark.createDataFrame(list(enumerate(LISTING)), "ord int, version string")
    requests = spark.createDataFrame([(1, wanted)], "request_id int, wanted string")
    assert tuple(m.resolve_versions(requests, listing).first()) == (1, version, status)


# A restatement of the rules, one request and one listing at a time.

_PRE = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
_SEMVER = re.compile(
    r"(0|[1-9]\d*)(?:\.(0|[1-9]\d*)(?:\.(0|[1-9]\d*)"
    rf"(-{_PRE}(?:\.{_PRE})*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)?)?"
)


def parsed(text):
    found = _SEMVER.fullmatch(text)
    return found and (found[1], found[2] or "0", found[3] or "0", found[4] or "")


def choose(listing, wanted):
    if not wanted:
        return listing[0] if listing else None
    want = parsed(wanted)
    for listed in listing:
        have = parsed(listed)
        if want and wanted == want[0]:
            if have and have[0] == want[0]:
                return listed
        elif want and wanted == f"{want[0]}.{want[1]}":
            if have and have[:2] == want[:2]:
                return listed
        elif wanted == listed or (want and parsed(listed.split("-")[0]) == want):
            return listed
    return None


def random_version(rng):
    text = ".".join(str(rng.randint(0, 3)) for _ in range(rng.randint(1, 3)))
    return text + rng.choice(["", "", "-1", "-19-1.focal", "+b", "-2+b.1", ".x", "-01", "+"])


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_random_requests_equal_the_restatement(spark, limit):
    rng = random.Random(11)
    listing = [random_version(rng) for _ in range(150)]
    wanted = [rng.choice([None, "", "8", "1", random_version(rng)]) for _ in range(1500)]
    index = spark.createDataFrame(list(enumerate(listing)), "ord int, version string")
    requests = spark.createDataFrame(list(enumerate(wanted)), "request_id int, wanted string")
    got = {r.request_id: r.version for r in m.resolve_versions(
        requests, index.repartition(4), limit=limit).collect()}
    assert got == {i: choose(listing, w) for i, w in enumerate(wanted)}


def test_listings_of_several_packages(spark):
    listing = spark.createDataFrame(
        [("a", 0, "8.0.1"), ("a", 1, "8.0.2"), ("b", 0, "5.7.1")],
        "package string, ord int, version string",
    )
    requests = spark.createDataFrame(
        [("a", 1, "8.0"), ("b", 2, "8.0"), ("b", 3, None)],
        "package string, request_id int, wanted string",
    )
    assert rows_of(m.resolve_versions(requests, listing, by=["package"])) == [
        ("a", 1, "8.0.1", "found"), ("b", 2, None, "not_found"), ("b", 3, "5.7.1", "default"),
    ]


def test_version_parts(spark):
    df = spark.createDataFrame([("8",), ("8.1-2",), ("8.0.28-19+b",), ("x",)], "v string")
    parts = df.select(*[f(F.col("v")) for f in (semver.major, semver.major_minor, semver.canonical)])
    assert [tuple(r) for r in parts.collect()] == [
        ("8", "8.0", "8.0.0"), (None, None, None), ("8", "8.0", "8.0.28-19"), (None, None, None),
    ]


def test_package_index_lines(spark):
    text = "Package: p\nVersion: 1:8.0\nX-Version-Note: a\n Version: b Version: c\n"
    df = spark.createDataFrame([("p", text), ("q", "Package: q\n"), ("r", "")], "package string, text string")
    assert rows_of(m.package_index(df)) == [
        ("p", 1, "1:8.0"), ("p", 2, "X-Version-Note: a"), ("p", 3, " b Version: c"),
    ]
    assert rows_of(m.package_index(df, prefix="Version: 1:"))[0] == ("p", 1, "8.0")

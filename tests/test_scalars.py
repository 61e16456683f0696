"""Endpoints and fingerprints."""

from __future__ import annotations

import random

import pytest

import moorage as m


def endpoint(spark, url, **options):
    df = spark.createDataFrame([(url,)], "url string")
    row = m.normalize_endpoints(df, "url", **options).first()
    return row.endpoint, row.has_userinfo, row.reason


@pytest.mark.parametrize(
    "url, expected",
    [
        ("http://h", ("http://h:80", False, None)),
        ("https://h/x", ("https://h:443/x", False, None)),
        ("http://h:8080", ("http://h:8080", False, None)),
        ("ftp://h", ("ftp://h", False, None)),
        ("h/x", (None, False, "no_scheme")),
        ("http://u:p@h", ("http://u:p@h:80", True, None)),
        ("HTTP://h?q=a:b@c", ("http://h:80?q=a:b@c", False, None)),
        ("https://[::1]/x", ("https://[::1]:443/x", False, None)),
        ("https://[::1]:9/x", ("https://[::1]:9/x", False, None)),
        ("http://a b", (None, False, "unparsable")),
        ("http://h:port", (None, False, "unparsable")),
        ("http://h/%zz", (None, False, "unparsable")),
        ("http://h/%20?%zz", ("http://h:80/%20?%zz", False, None)),
        ("http://h/a\tb", (None, False, "unparsable")),
        (" http://h", (None, False, "no_scheme")),
        ("", (None, False, "no_scheme")),
        (None, (None, False, "no_scheme")),
    ],
)
def test_endpoints(spark, url, expected):
    assert endpoint(spark, url) == expected


def test_endpoint_options(spark):
    assert endpoint(spark, "http://h/a/b?q#f", clear_path=True)[0] == "http://h:80?q#f"
    assert endpoint(spark, "http://h", user_info="u:p")[0] == "http://u:p@h:80"
    assert endpoint(spark, "http://x:y@h", user_info="u:p")[0] == "http://x:y@h:80"
    assert endpoint(spark, "http://x:y@h/z", redact=True)[:2] == ("http://h:80/z", True)


def fnv(data, multiply_first):
    value = 14695981039346656037
    for byte in data:
        if multiply_first:
            value = value * 1099511628211 % 2**64 ^ byte
        else:
            value = (value ^ byte) * 1099511628211 % 2**64
    return value - 2**64 if value >= 2**63 else value


def test_known_fingerprints(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "s string")
    got = [r[0] for r in m.fingerprint_rows(df, ["s"]).select("fnv1a_64").collect()]
    assert got == [-3750763034362895579, -5808556873153909620, -8821353812377114648, None]


@pytest.mark.parametrize("algorithm", ["fnv1a_64", "fnv_64"])
def test_fingerprints_equal_brute_force(spark, algorithm):
    rng = random.Random(3)
    letters = "abcXYZ 09é漢🚀\n"
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 5, 40, 900]))) for _ in range(400)]
    texts += ["long" * 9000, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.h for r in m.fingerprint_rows(df.repartition(3), ["s"], algorithm, into="h").collect()}
    assert got == {
        i: None if t is None else fnv(t.encode(), algorithm == "fnv_64") for i, t in enumerate(texts)
    }


def test_document_texts_equal_brute_force(spark, folder):
    from workload.queries import queries

    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.fnv1a_64 for r in queries()["fingerprint_texts"](spark, folder).collect()}
    assert got == {r.doc_id: fnv(r.text.encode(), False) for r in texts}


def test_several_columns_and_murmur(spark):
    df = spark.createDataFrame([(1, None), (12, "3")], "a int, b string")
    got = m.fingerprint_rows(df, ["a", "b"], separator="|").collect()
    assert [r.fnv1a_64 for r in got] == [fnv(b"1|", False), fnv(b"12|3", False)]
    assert m.fingerprint_rows(df, ["a"], "murmur").selectExpr("murmur = hash(a) as same").distinct().collect()[0].same
    with pytest.raises(ValueError, match="unknown algorithm"):
        m.fingerprint_rows(df, ["a"], "md5")

from __future__ import annotations

import configparser
import random
import json

import pytest
from helpers import plan_of, rows_of
from pyspark.sql import functions as F

import moorage as m



def parse(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, doc string")
    rows = m.ini_rows(df).orderBy("ord")
    return [(r.section, r.key, r.value, r.valueless) for r in rows.collect()]


def test_ini_edge_cases(spark):
    text = (
        "early = 1\n"
        "# note\n"
        "[mysqld]\r\n"
        "a=b=c\n"
        "empty =\n"
        "\tskip-name-resolve \n"
        "; other = note\n"
        "x : y\n"
        "said = 'two words'  \n"
        "behind = v ; why\n"
        "fenced = `a#b`\n"
        "\n"
        "  [ client ]\n"
        "user = root"
    )
    assert parse(spark, text) == [
        (None, "early", "1", False),
        ("mysqld", "a", "b=c", False),
        ("mysqld", "empty", "", False),
        ("mysqld", "skip-name-resolve", "true", True),
        ("mysqld", "x", "y", False),
        ("mysqld", "said", "two words", False),
        ("mysqld", "behind", "v", False),
        ("mysqld", "fenced", "a#b", False),
        ("client", "user", "root", False),
    ]


def test_lines_ending_in_a_backslash_go_on(spark):
    text = (
        "# note \\\n"
        "a = 1\\\n"
        "   2\\\n"
        "#3\n"
        "; note \\\n"
        "[s] \n"
        "b = \\\n"
        "[x]\n"
        "c = back\\slash"
    )
    assert parse(spark, text) == [
        (None, "a", "12", False), ("s", "b", "[x]", False), ("s", "c", "back\\slash", False),
    ]


@pytest.mark.parametrize("text", ["", "\n\n", "# only\n", "[empty]\n"])
def test_ini_without_keys(spark, text):
    assert parse(spark, text) == []


def test_parsing_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a=1")], "doc_id int, doc string")
    plan = m.ini_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_written_documents_parse_back(spark):
    rows = [
        (1, 0, None, "early", "1"),
        (1, 1, "b", "k1", "plain"),
        (1, 2, "a", "k2", "with # mark"),
        (1, 3, "b", "k3", " spaced "),
        (2, 0, "only", "k", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id int, ord int, section string, key string, value string")
    docs = m.ini_documents(df.repartition(3))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[1] == (
        "early = 1\n\n[b]\nk1 = plain\nk3 = \" spaced \"\n\n[a]\nk2 = `with # mark`\n"
    )
    again = m.ini_rows(docs.withColumnRenamed("text", "doc"))
    assert rows_of(again.select("doc_id", "section", "key", "value")) == sorted(
        ((d, s, k, v) for d, _, s, k, v in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def test_a_large_document_comes_in_parts_in_order(spark):
    rows = [(1, i, f"s{i % 3}", f"key{i}", str(i)) for i in range(200)]
    rows += [(2, i, "s", f"key{i}", str(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, section string, key string, value string")
    docs = m.ini_documents(df, part_keys=20).collect()
    assert [r.part for r in docs if r.doc_id == 2] == [0]
    parts = sorted((r.part, r.text) for r in docs if r.doc_id == 1)
    assert [p for p, _ in parts] == list(range(10))
    assert {text.count(" = ") for _, text in parts} == {20}
    seen = []
    for _, text in parts:
        part = configparser.ConfigParser()
        part.read_string(text)
        seen += [(s, k, part[s][k]) for s in part.sections() for k in part[s]]
    in_order = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[2], r[1]))
    assert seen == [(s, k, v) for _, _, s, k, v in in_order]


def test_a_doubled_key_keeps_its_place_and_last_value(spark):
    df = spark.createDataFrame([(1, "[s]\nk = 1\nj = 0\nk = 2\n")], "doc_id int, doc string")
    assert m.ini_documents(m.ini_rows(df)).first().text == "[s]\nk = 2\nj = 0\n"


def test_comments_survive_an_edit(spark):
    text = "# first\n; second\nearly = 1\n\n# of the section\n[s]\nk = 1\n# above j\nj = 2\n"
    docs = spark.createDataFrame([(1, text)], "doc_id int, doc string")
    edit = spark.createDataFrame([(1, "s", "j", "3")], "doc_id int, section string, key string, value string")
    edited = m.ini_documents(m.overlay_config([("base", m.ini_rows(docs)), ("edit", edit)]))
    assert edited.first().text == text.replace("j = 2", "j = 3")


def test_what_is_written_is_read_back(spark):
    """Random sections, keys and values through the writer and the reader."""
    rng = random.Random(11)
    pieces = ["a", "Z9", " ", "\t", "#", ";", "=", ":", "'", '"', "`", "\n", "\\", "[", "]", "ü", "\n\n"]
    rows = []
    for doc in range(60):
        for key in range(6):
            value = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))
            if '"""' in value and ("\n" in value or "`" in value):
                continue
            section = rng.choice([None, "s one", "t"])
            rows.append((doc, key, section, f"k{key}.{rng.choice('xyz')}", value))
    rows += [(99, 0, "s", "k", "x\ny"), (99, 1, "s", "q", '"q"'), (99, 2, "s", "b", "p`q")]
    df = spark.createDataFrame(rows, "doc_id int, ord int, section string, key string, value string")
    again = m.ini_rows(m.ini_documents(df).withColumnRenamed("text", "doc"))
    got = {(r.doc_id, r.section, r.key): r.value for r in again.collect()}
    want = {(d, s, k): v for d, _, s, k, v in rows}
    assert {k: v for k, v in got.items() if want.get(k) != v} == {}
    assert len(got) == len(want)


def layer(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id int, section string, key string, value string")


def test_last_layer_wins_and_the_rest_stays(spark):
    base = layer(spark, (1, "s", "a", "1"), (1, "s", "b", "2"), (2, None, "c", "3"))
    middle = layer(spark, (1, "s", "a", "10"), (1, "t", "n", "5"))
    top = layer(spark, (1, "s", "a", None), (2, None, "c", "30"))
    merged = m.overlay_config([("base", base), ("middle", middle), ("top", top)])
    assert rows_of(merged.select("doc_id", "section", "key", "value", "source")) == [
        (1, "s", "a", None, "top"), (1, "s", "b", "2", "base"),
        (1, "t", "n", "5", "middle"), (2, None, "c", "30", "top"),
    ]


def test_a_repeated_key_takes_its_last_value_and_first_place(spark):
    docs = spark.createDataFrame([(1, "[s]\na=1\nb=2\n[t]\nx=1\n[s]\na=3\n")], "doc_id int, doc string")
    text = m.ini_documents(m.overlay_config([("base", m.ini_rows(docs))])).first().text
    assert text == "[s]\na = 3\nb = 2\n\n[t]\nx = 1\n"


def test_credentials_file(spark):
    rows = layer(spark, (1, "client", "user", "manager"), (1, "client", "password", "p#1"))
    ordered = rows.withColumn("ord", F.when(F.col("key") == "user", 0).otherwise(1))
    assert m.ini_documents(ordered).first().text == "[client]\nuser = manager\npassword = `p#1`\n"


def test_compact_json_leaves_zero_values_out(spark):
    df = spark.createDataFrame(
        [
            (0, False, "", [], {}, (None, 0), [("", 1)], 0.0, "keep"),
            (7, True, "x", ["a"], {"k": ""}, ("v", 3), [("y", 0)], 1.5, None),
            (None, None, None, None, None, None, None, None, None),
        ],
        "n int, flag boolean, s string, list array<string>, map map<string,string>, "
        "sub struct<a:string,b:int>, items array<struct<p:string,q:int>>, x double, last string",
    )
    texts = [json.loads(r.json) for r in m.compact_json(df, df.columns).collect()]
    assert texts == [
        {"sub": {}, "items": [{"q": 1}], "last": "keep"},
        {"n": 7, "flag": True, "s": "x", "list": ["a"], "map": {"k": ""},
         "sub": {"a": "v", "b": 3}, "items": [{"p": "y"}], "x": 1.5},
        {"sub": {}},
    ]


def test_nothing_is_sorted_where_texts_are_read(spark):
    """A task that reads few bytes of texts makes very many rows: they are dealt out before any sort."""
    docs = spark.createDataFrame([(1, "[s]\na=1\nb=2\n"), (2, "[s]\na=1\n")], "doc_id int, doc string")
    rows = m.ini_rows(docs)
    for made in (m.overlay_config([("base", rows)]), m.ini_documents(rows), m.ini_documents(rows, part_keys=1),
                 m.ini_documents(m.overlay_config([("base", rows)]))):
        plan = plan_of(made)
        assert "Exchange" in plan
        # What stands below the last exchange of a plan reads the texts.
        assert "Sort" not in plan[plan.rindex("Exchange"):]

"""Edits of stored documents, against overlaying the whole table."""

from __future__ import annotations

import os
import random

import pytest
from helpers import rows_of

import moorage as m
from moorage.plans import read_document_store, upsert_documents, write_document_store

EDITS = "doc_id bigint, section string, key string, value string, ord int"


@pytest.fixture
def docs(spark):
    rng = random.Random(4)
    texts = [
        "\n".join(f"[s{s}]\n# note {s}\n" + "\n".join(f"k{k} = {rng.randint(0, 99)}" for k in range(3)) for s in range(rng.randint(0, 3)))
        for _ in range(80)
    ]
    return spark.createDataFrame([*enumerate(texts), (200, None), (201, "")], "doc_id bigint, text string")


@pytest.fixture
def store(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    write_document_store(docs, path, buckets=16)
    return path


def files(path):
    """Every data file with its time stamp and size."""
    return {
        os.path.join(at, name): (os.stat(os.path.join(at, name)).st_mtime_ns, os.stat(os.path.join(at, name)).st_size)
        for at, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


def overlaid(docs, edits):
    """(doc_id, text) by a plain overlay of everything; documents without edits keep their texts."""
    rendered = m.ini_documents(m.overlay_config([("a", m.ini_rows(docs, doc="text")), ("b", edits)])).collect()
    edited = {r.doc_id for r in edits.collect()} - {None}
    texts = {r.doc_id: r.text for r in docs.collect()}
    return texts | {r.doc_id: r.text for r in rendered if r.doc_id in edited}


def stored(spark, path):
    rows = read_document_store(spark, path).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text for r in rows}


ROWS = [(3, "s0", "k1", "new", 1), (3, "s0", "k1", "newer", 2), (3, "other", "x", "y # z", 3), (7, None, "top", "1", 1),
        (500, "fresh", "a", "b", 1), (500, "fresh", "c", "d", 2), (None, "s", "k", "v", 1), (200, "s", "k", "v", 1)]


def test_only_edited_partitions_change(spark, docs, store):
    edits = spark.createDataFrame(ROWS, EDITS)
    want, before = overlaid(docs, edits), files(store)
    touched = upsert_documents(spark, store, edits, buckets=16)
    after = files(store)
    assert stored(spark, store) == want and want[3].count("newer") == 1 and 500 in want
    assert 0 < len(touched) < 16
    bucket = lambda name: int(name.split("bucket=")[1].split("/")[0])
    assert {n: s for n, s in before.items() if bucket(n) not in touched} == {n: s for n, s in after.items() if bucket(n) not in touched}
    assert not {n for n in before if bucket(n) in touched} & set(after)


def test_the_same_edits_again_change_no_text(spark, docs, store):
    edits = spark.createDataFrame(ROWS, EDITS)
    upsert_documents(spark, store, edits, buckets=16)
    once = stored(spark, store)
    upsert_documents(spark, store, edits, buckets=16)
    assert stored(spark, store) == once


def test_no_edits_touch_nothing(spark, store):
    before = files(store)
    assert upsert_documents(spark, store, spark.createDataFrame([ROWS[6]], EDITS), buckets=16) == []
    assert upsert_documents(spark, store, spark.createDataFrame([], EDITS), buckets=16) == []
    assert files(store) == before


def test_edits_of_everything_equal_a_full_overlay(spark, docs, store):
    edits = spark.createDataFrame([(i, "s1", "k9", f"v{i}", 1) for i in range(80)], EDITS)
    assert len(upsert_documents(spark, store, edits, buckets=16)) == len({r.bucket for r in read_document_store(spark, store).where("doc_id < 80").collect()})
    assert stored(spark, store) == overlaid(docs, edits)
    keys = rows_of(m.ini_rows(read_document_store(spark, store), doc="text").where("key = 'k9'").select("doc_id", "value"))
    assert sorted(keys) == sorted((i, f"v{i}") for i in range(80))

"""Delivery of telemetry: repeats, bad records and receivers that fail."""

from __future__ import annotations

import json

import pytest
from helpers import rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

import moorage as m
from moorage.sources import shared_folder
from moorage.streaming import Delivery, config_stream, encoded_telemetry, files_receiver

SCHEMA = "config_id string, resource string, instance_type string, password string, disable_telemetry boolean, sent_at string"
GOOD, BAD_TIME = "2024-01-01T00:00:00Z", "tomorrow"
RECORDS = [
    {"config_id": "a", "resource": "ps", "instance_type": "t", "password": "hush", "sent_at": GOOD},
    {"config_id": "b", "resource": "pxc", "disable_telemetry": True, "sent_at": GOOD},
    {"config_id": "c", "resource": "pmm", "sent_at": BAD_TIME, "password": "hush"},
    {"config_id": "d", "resource": "vm", "sent_at": GOOD},
    {"config_id": "", "resource": "ps", "sent_at": GOOD},
    {"config_id": "e", "sent_at": None},
    {"config_id": "f", "resource": "pmm"},
    {"config_id": "a", "resource": "ps", "instance_type": "t", "sent_at": GOOD},
]
REASONS = [("c", "no_time"), ("d", "unknown_resource"), ("e", "unknown_resource"), ("f", "no_time")]
KEY = T.StructField("config_id", T.StringType())


@pytest.fixture
def folder_of_configs(tmp_path):
    folder = tmp_path / "configs"
    folder.mkdir()
    for number, part in enumerate((RECORDS[:3], RECORDS[3:])):
        (folder / f"{number}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
    return str(folder)


def stream(spark, folder):
    return config_stream(spark, folder, schema=T.StructType.fromDDL(SCHEMA), max_files_per_trigger=1)


def letters(df):
    return sorted((r.config_id, r.reason) for r in df.collect())


def delivered(delivery, spark):
    return rows_of(delivery.outcomes(spark).where("reason is null").select("config_id", "json"))


def test_stream_equals_batch_and_replays_add_nothing(spark, folder_of_configs):
    batch = spark.read.schema(SCHEMA).json(folder_of_configs)
    want = rows_of(encoded_telemetry(m.reportable(batch), version="1").where("reason is null").select("config_id", "json"))
    assert [w[0] for w in want] == ["a", "a"] and "hush" not in str(want)
    path = shared_folder(spark, "delivery")
    delivery = Delivery(path, KEY, receiver=files_receiver(f"{path}/out"), version="1")
    # The second run has lost its checkpoint and repeats both batches.
    for _ in range(2):
        delivery.start(stream(spark, folder_of_configs), shared_folder(spark, "state")).awaitTermination()
        assert delivered(delivery, spark) == want
        assert letters(delivery.dead_letters(spark)) == REASONS
        assert sorted(r.value for r in spark.read.text(f"{path}/out").select("value").collect()) == sorted(w[1] for w in want)
    assert {r.batch_id for r in delivery.outcomes(spark).collect()} == {0, 1}
    assert delivery.resend(spark) == []


class Receiver:
    """Keeps what it takes by batch, and refuses as many calls of a batch as it is told."""

    def __init__(self, refusals):
        self.refusals, self.taken, self.calls = dict(refusals), {}, []

    def __call__(self, documents, batch_id):
        self.calls.append(batch_id)
        if self.refusals.get(batch_id, 0) > 0:
            self.refusals[batch_id] -= 1
            raise ConnectionError("hush")
        self.taken[batch_id] = sorted(r.config_id for r in documents.collect())


def test_a_refused_batch_is_sent_once_more(spark, folder_of_configs):
    receiver = Receiver({0: 1})
    delivery = Delivery(shared_folder(spark, "delivery"), KEY, receiver=receiver, version="1")
    delivery.start(stream(spark, folder_of_configs), shared_folder(spark, "state")).awaitTermination()
    assert receiver.calls == [0, 0, 1] and receiver.taken == {0: ["a"], 1: ["a"]}
    assert letters(delivery.dead_letters(spark)) == REASONS


def test_a_batch_refused_twice_stops_nothing_and_is_resent(spark, folder_of_configs):
    receiver = Receiver({0: 3})
    delivery = Delivery(shared_folder(spark, "delivery"), KEY, receiver=receiver, version="1")
    delivery.start(stream(spark, folder_of_configs), shared_folder(spark, "state")).awaitTermination()
    assert receiver.calls == [0, 0, 1] and receiver.taken == {1: ["a"]}
    assert letters(delivery.dead_letters(spark)) == sorted([("a", "not_sent"), *REASONS])
    assert delivery.resend(spark) == [0] and receiver.taken == {0: ["a"], 1: ["a"]}
    assert letters(delivery.dead_letters(spark)) == REASONS
    assert delivery.resend(spark) == [] and len(receiver.calls) == 5


def test_what_is_refused_again_stays_a_dead_letter(spark, folder_of_configs):
    receiver = Receiver({0: 99, 1: 99})
    delivery = Delivery(shared_folder(spark, "delivery"), KEY, receiver=receiver, version="1")
    delivery.start(stream(spark, folder_of_configs), shared_folder(spark, "state")).awaitTermination()
    assert delivery.resend(spark) == [] and delivered(delivery, spark) == []
    assert letters(delivery.dead_letters(spark)) == sorted([("a", "not_sent")] * 2 + REASONS)


def test_empty_batches_and_times_of_other_types(spark):
    configs = spark.createDataFrame([("x", "ps", None, "p", None, None)], SCHEMA)
    receiver = Receiver({})
    delivery = Delivery(shared_folder(spark, "delivery"), KEY, receiver=receiver, version="1")
    delivery.prepare(spark)
    assert delivery.outcomes(spark).count() == 0
    delivery.deliver(configs.limit(0), 0)
    timed = configs.withColumn("sent_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    delivery.deliver(timed, 1)
    assert receiver.taken == {0: [], 1: ["x"]}
    assert [(r.config_id, r.reason, r.batch_id) for r in delivery.outcomes(spark).collect()] == [("x", None, 1)]

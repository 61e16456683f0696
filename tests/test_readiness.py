"""Since when clusters are ready, against going through all events in turn."""

from __future__ import annotations

import datetime
import random

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

import moorage as m

SCHEMA = "cluster_id bigint, member string, at timestamp_ntz, ord int, state string"
START = datetime.datetime(2024, 3, 1)


def moment(minutes):
    return START + datetime.timedelta(minutes=minutes)


def brute(events):
    out = []
    for cluster in sorted({e[0] for e in events if e[0] is not None}):
        own = [e for e in events if e[0] == cluster and e[1] is not None and e[2] is not None and e[4] in ("answers", "silent", "gone")]
        states, first, since, ready = {}, None, None, False
        for at in sorted({e[2] for e in own}):
            for _, member, _, _, state in sorted((e for e in own if e[2] == at), key=lambda e: (e[3], e[4])):
                states[member] = state
            present = [s for s in states.values() if s != "gone"]
            was, ready = ready, bool(present) and "silent" not in present
            first = at if ready and first is None else first
            since = (since if was else at) if ready else None
        if own:
            present = [s for s in states.values() if s != "gone"]
            out.append((cluster, len(present), present.count("silent"), ready, first, since))
    return out


def swept(spark, events, **options):
    return sorted(rows_of(m.ready_since(spark.createDataFrame(events, SCHEMA).repartition(3), **options)))


def fleet(seed, clusters, members, count, span):
    rng = random.Random(seed)
    states = ["answers", "answers", "answers", "silent", "gone"]
    return [
        (rng.randint(1, clusters), f"m{rng.randint(1, members)}", moment(rng.randint(0, span)), rng.randint(0, 5), rng.choice(states))
        for _ in range(count)
    ]


@pytest.mark.parametrize("slot", [F.to_date, lambda at: F.lit(0), lambda at: F.date_format(at, "yyyyMMddHHmm")])
def test_sweep_equals_going_through_the_events(spark, slot):
    """Ties between members and of one member, repeats, members that leave and come back."""
    events = fleet(1, 6, 4, 400, 5000) + fleet(2, 3, 2, 200, 60)
    events += events[::7]
    events += [(None, "m1", moment(1), 1, "answers"), (1, None, moment(1), 1, "silent"), (1, "m1", None, 1, "silent"),
               (2, "m2", moment(2), 1, "unknown"), (3, "m1", moment(3), 1, None), (50, "m", moment(9), 1, "unknown")]
    assert swept(spark, events, slot=slot) == brute(events)


def test_single_stories(spark):
    say = lambda cluster, *told: [(cluster, who, moment(at), n, what) for n, (at, who, what) in enumerate(told)]
    events = (
        say(1, (0, "a", "silent"), (5, "b", "answers"), (9, "a", "answers"))
        + say(2, (0, "a", "answers"), (5, "b", "silent"))
        + say(3, (0, "a", "answers"), (5, "b", "silent"), (2000, "b", "gone"))
        + say(4, (0, "a", "answers"), (1, "a", "gone"))
        + say(5, (0, "a", "answers"), (3, "a", "answers"), (3, "b", "answers"))
        + say(6, (0, "a", "gone"), (4000, "a", "answers"))
    )
    assert swept(spark, events) == [
        (1, 2, 0, True, moment(9), moment(9)),
        (2, 2, 1, False, moment(0), None),
        (3, 1, 0, True, moment(0), moment(2000)),
        (4, 0, 0, False, moment(0), None),
        (5, 2, 0, True, moment(0), moment(0)),
        (6, 1, 0, True, moment(4000), moment(4000)),
    ]
    assert swept(spark, events) == brute(events)


def test_no_events(spark):
    assert swept(spark, []) == []

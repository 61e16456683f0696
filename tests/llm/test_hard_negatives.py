from __future__ import annotations

import math
import random

import numpy as np
import pytest
from cases import empty

from moorage.llm import hardnegatives as h

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, key int, whole int, _a int, rank int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 7), (33, 65, 34), (130, 200, 97), (3, 0, 4), (0, 8, 8), (64, 64, 64)])
def test_strassen_equals_plain_products(shape):
    r = np.random.default_rng(5)
    a, b = r.integers(-(1 << 26), 1 << 26, shape[:2]), r.integers(-(1 << 26), 1 << 26, shape[1:])
    assert (h.strassen(a, b) == a @ b).all()


def test_strassen_is_exact_at_the_edge_of_64_bits():
    a = np.full((40, 40), 0, np.int64)
    a[:, 0] = (1 << 62) + 3
    b = np.zeros((40, 40), np.int64)
    b[0] = 1
    assert (h.strassen(a, b) == (1 << 62) + 3).all()


def test_heaps_merge_to_the_heap_of_all():
    rng = random.Random(6)
    entries = [(rng.randrange(4), rng.randrange(6), rng.randrange(9)) for _ in range(200)]
    whole = h.Heaps(4, 5)
    for at in range(0, 200, 17):
        whole.push(*(np.array(x) for x in zip(*entries[at : at + 17])))
    want = sorted(
        e for row in range(4) for e in sorted({e for e in entries if e[0] == row}, key=lambda e: (-e[1], e[2]))[:5]
    )
    assert sorted(zip(whole.row.tolist(), whole.score.tolist(), whole.key.tolist())) == want


def brute(rows, scale=256, positives=5, negatives=10):
    usable = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(scale * float(np.float32(x))) for x in vector]
        if sum(x * x for x in whole) < 1 << 55:
            usable.append((key, tuple(whole), label))
    out = []
    for anchor in sorted({u for u in usable if u[0] % 100 == 0}):
        scored = sorted(
            {(-sum(a * b for a, b in zip(anchor[1], u[1])), u[0], u[2] == anchor[2])
             for u in usable if len(u[1]) == len(anchor[1])}
        )
        near = [(-s, k) for s, k, same in scored if same and k != anchor[0]][:positives]
        for score, key in near:
            found = [(-s, k) for s, k, same in scored if not same and 30 * score <= -100 * s <= 90 * score]
            out += [(anchor[0], key, n + 1, k, score, s) for n, (s, k) in enumerate(found[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def mined(df):
    return sorted(map(tuple, h.hard_negatives(df, df.where("vec_id % 100 = 0")).collect()))


@pytest.mark.parametrize("cells", [(4096, 4096, 512), (7, 60, 5)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cells):
    """Ties by equal vectors, repeated rows, unlike sizes, and whatever takes no part."""
    monkeypatch.setattr(h, "ANCHOR_CELL", cells[0])
    monkeypatch.setattr(h, "CANDIDATE_CELL", cells[1])
    monkeypatch.setattr(h, "LEAST_CELL", cells[1])
    monkeypatch.setattr(h, "ANCHOR_TILE", cells[2])
    monkeypatch.setattr(h, "CANDIDATE_TILE", 16 * cells[2])
    rng = random.Random(7)
    vector = lambda n=40: [rng.choice([-0.5, 0.1, 0.25, rng.random()]) for _ in range(n)]
    rows = [(i, vector(), rng.randrange(3)) for i in range(600)]
    rows += [(600 + i, list(rows[i % 9][1]), i % 3) for i in range(60)]
    rows += [(700, vector(3), 1), (701, vector(3), 1), (702, vector(3), 2), (800, [], 0), (801, [], 0), (802, [], 1)]
    rows += [rows[0], rows[5], rows[100], rows[100], (900, [9e9] * 40, 1), (901, [9e9] * 40, 1)]
    rows += [(None, vector(), 1), (903, None, 1), (1000, vector(), None), (904, [None] * 40, 1),
             (905, [math.nan] * 40, 2), (1100, [math.inf] * 40, 1), (1200, [0.0] * 40, 2), (1300, vector(), 77)]
    rng.shuffle(rows)
    df = frame(spark, rows).repartition(5)
    assert mined(df) == brute(rows)


def test_one_label_holds_nearly_everything(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(8)], 0 if i % 50 else 1) for i in range(500)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_empty_tables(spark):
    df = frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])
    assert mined(empty(df)) == []
    assert h.hard_negatives(df, empty(df)).count() == 0
    assert h.hard_negatives(empty(df), df).count() == 0

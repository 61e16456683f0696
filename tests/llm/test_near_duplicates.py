from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from cases import empty, odd_documents, roots, words

from moorage.llm import embeddings, simhash
from moorage.llm.components import connected_components


def brute_fingerprint(text):
    found = words(text)
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    found = roots([k if k is not None else 1 << 62 for k, _ in rows], links)
    return sorted(
        ((k, f"{p:016x}", r if r < 1 << 62 else None) for (k, _), p, r in zip(rows, prints, found)), key=str
    )


def result(df):
    found = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id")
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("block", [4, 2048])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    rows = []
    for doc in range(40):
        text = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 120))]
        for copy in range(rng.choice([1, 1, 1, 6])):
            changed = list(text)
            if copy:
                changed[rng.randrange(len(text))] = f"v{copy}"
            rows.append((doc * 10 + copy, " ".join(changed)))
    want = brute_simhash(rows)
    assert len({w[2] for w in want}) < len(rows)
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == want


def test_a_dense_ball_of_fingerprints_is_one_component(spark, monkeypatch):
    """More neighbours than a block holds, all of them within the radius of one another."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    near = [0] + [1 << b for b in range(64)]
    far = [(1 << 40) - 1, (1 << 41) - 1, 0x5555555555555555]
    values = np.array(near + far, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    parts = connected_components(simhash.near_links(df)).collect()
    groups = {}
    for r in parts:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 65]


def test_shards_lose_no_neighbour():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64)
    near = points ^ flips ^ np.roll(flips, 1)
    every = np.concatenate([points, near])
    rows, leaves = simhash.VantageTree(every, 6).shards(every)
    homes = {}
    for row, leaf in zip(rows.tolist(), leaves.tolist()):
        homes.setdefault(row, set()).add(leaf)
    assert all(homes[i] & homes[i + 800] for i in range(800))
    assert len(rows) < 6 * len(every)


def test_odd_documents(spark):
    df = odd_documents(spark)
    assert result(df) == brute_simhash([(r.doc_id, r.text) for r in df.collect()])
    assert result(empty(df)) == []


@pytest.mark.parametrize("shape", ["chain", "star", "two"])
def test_connected_components(spark, shape):
    links = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(0, i) for i in range(1, 300)] + [(300, 5)],
        "two": [(5, 9), (9, 7), (1, 2), (2, 2), (None, 3)],
    }[shape]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    if shape == "two":
        assert found == {5: 5, 9: 5, 7: 5, 1: 1, 2: 1}
    else:
        assert set(found.values()) == {0} and len(found) == {"chain": 201, "star": 301}[shape]


def brute_vectors(rows):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for i, (_, v, l) in enumerate(rows):
        for j in range(i):
            _, w, k = rows[j]
            if l == k and usable(v, l) and usable(w, k) and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links.append((i, j))
    found = roots([r[0] for r in rows], links)
    counts = [sum(i in link for link in links) for i in range(len(rows))]
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, counts, found))


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for center in range(25):
        base = rng.standard_normal(16)
        for _ in range(30 if center == 0 else int(rng.integers(1, 4))):
            rows.append(((base + 0.06 * rng.standard_normal(16)).astype(np.float32).tolist(), center % 3))
    rows += [rows[0]] * 4 + [([0.0] * 16, 1), (None, 1), ([], 1), ([float("nan")] * 16, 1), ([1.0, None], 1),
                             (rows[5][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e30, 0.0], 2), ([-0.0, 1.0], 2), ([0.0, 1.0], 2)]
    rows = [(i, v, l) for i, (v, l) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    found = embeddings.near_duplicates(df)
    assert sorted(map(tuple, found.select("vec_id", "n_links", "component_id", "kept").collect())) == brute_vectors(rows)
    assert embeddings.near_duplicates(empty(df)).count() == 0


def test_tables_meet_the_allowed_chance_of_a_miss():
    for vectors in (10, 10_000, 10**9):
        projections, tables = embeddings.table_shape(vectors, 0.93)
        near = embeddings.collision((2 - 2 * 0.93) ** 0.5) ** projections
        assert (1 - near) ** tables <= embeddings.MISS

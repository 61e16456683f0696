from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import empty, odd_documents

from moorage.llm import substrings, suffixes


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 60))]
        assert suffixes.suffix_array(np.array(text, np.uint16)).tolist() == sorted(
            range(len(text)), key=lambda i: text[i:]
        )


def test_repeated_windows_equal_counting():
    rng = random.Random(2)
    for _ in range(300):
        length, chars = rng.choice([2, 3, 5]), bytes([0, 97, 98, 255])[: rng.randint(2, 4)]
        pieces = [bytes(rng.choice(chars) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        weights = [rng.choice([1, 1, 2]) for _ in pieces]
        counts = Counter()
        for piece, weight in zip(pieces, weights):
            for i in range(len(piece) - length + 1):
                counts[piece[i : i + length]] += weight
        want = [[i for i in range(len(p) - length + 1) if counts[p[i : i + length]] > 1] for p in pieces]
        assert [found.tolist() for found in suffixes.repeated_windows(pieces, weights, length)] == want


def test_long_runs_are_compared_in_few_steps(monkeypatch):
    """A run of one char has one prefix as long as itself: not a step for every eight chars."""
    steps = []
    count = np.bitwise_count
    monkeypatch.setattr(suffixes.np, "bitwise_count", lambda x: steps.append(len(x)) or count(x))
    found = suffixes.repeated_windows([b"z" * 40_000, b"y" * 400 + b"x"], [1, 1], 400)
    assert [len(f) for f in found] == [39_601, 0]
    assert len(steps) < 100


def test_prefixes_from_the_least_length_on_are_exact():
    rng = random.Random(6)
    for _ in range(200):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        least = rng.choice([1, 3, 6])
        text = np.array([c for p in pieces for c in [*(b + 1 for b in p), 0]], np.uint16)
        room = np.array([len(p) - k for p in pieces for k in range(len(p) + 1)], np.int32)
        array = suffixes.suffix_array(text)
        found = suffixes.common_prefixes(text, array, room, least)
        for b, a in zip(array[:-1].tolist(), array[1:].tolist()):
            most = min(room[a], room[b])
            want = next((k for k in range(most) if text[a + k] != text[b + k]), most)
            assert found[a] == want if want >= least else found[a] < least


def brute(rows, length):
    texts = [(key, (text or "").encode()) for key, text in rows]
    counts = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    found = substrings.remove_repeated(df, **options)
    return sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("heavy", [1 << 22, 200])
def test_removal_equals_brute_force(spark, monkeypatch, heavy):
    """Copies, near copies, a shared passage in many settings, runs of one character."""
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(25)
    texts = [prose(60) for _ in range(10)] + [f"{prose(8)} {passage} {prose(8)}" for _ in range(12)]
    texts += [texts[0]] * 3 + [texts[1][:150] + "!" + texts[1][150:]] + ["z" * 300, "ab" * 200, prose(5) + "z" * 90]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(df, length=40) == brute(rows, 40)


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = result(df)
    assert len(got) == len(rows)
    by_key = {g[0]: g for g in got}
    assert by_key[4][2] == 60_000 and by_key[4][3] == 1
    assert by_key[1][1:4] == (0, 0, 0) and by_key[5][1:4] == (28, 0, 0)
    assert result(df, length=10)  # repeated rows repeat each other
    assert {g[2] for g in result(df, length=10) if g[0] == 5} == {28}
    assert result(empty(df)) == []

from __future__ import annotations

import random

from test_rules_and_pipeline import brute_tiles

from moorage.llm import decontaminate


def test_contamination_equals_brute_force_with_repetitive_items(spark):
    rng = random.Random(41)
    phrase = "the same five words again "
    items = {1: phrase * 11, 2: "a b a b a b a b a b a b a b", 3: " ".join(f"u{i}" for i in range(40))}
    for i in range(4, 10):
        items[i] = " ".join(rng.choice("xyz") for _ in range(rng.randint(6, 30)))
    documents = {1: f"before {phrase * 11} after", 2: phrase, 3: "so a b a b a b a end", 4: " ".join(f"u{i}" for i in range(7)),
                 5: "nothing at all is shared here"}
    for i in range(6, 20):
        documents[i] = " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    df = spark.createDataFrame(list(documents.items()), "doc_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(df, benchmark).collect()}
    assert len(found) == len(documents)
    for key, text in documents.items():
        covered = {}
        for item, wanted in items.items():
            share = brute_tiles(wanted.split(), text.split(), 5) / len(wanted.split())
            if share:
                covered[item] = share
        best = min(covered, key=lambda i: (-covered[i], i), default=None)
        row = found[key]
        assert (row.item_id, row.covered) == (best, covered.get(best, 0.0))
        assert row.n_items == sum(c >= 0.5 for c in covered.values())
        assert row.contaminated == (row.n_items > 0)
    assert found[1].contaminated and found[1].covered == 1.0
    assert 0 < found[4].covered < 0.5 and found[4].item_id == 3

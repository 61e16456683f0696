from __future__ import annotations

import random

import pytest
from cases import empty, roots

from moorage.llm import queries, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(rng, n=40):
    return " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))


def test_near_copies_equal_all_pairs(spark):
    """One document of each group of fingerprints within two bits: that of the smallest id."""
    import corpus_pipeline as pipeline

    rng = random.Random(41)
    texts = []
    for _ in range(12):
        base = prose(rng, 300).split()
        texts += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 2)):
            changed = list(base)
            changed[rng.randrange(300)] = "other"
            texts.append(" ".join(changed))
    texts += ["", None, " \n", "one", "ONE"]
    rng.shuffle(texts)
    df = documents(spark, list(enumerate(texts))).repartition(3)
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = sorted(set(roots(list(range(len(texts))), links)))
    kept = pipeline.without_near_copies(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == want
    assert len(want) < len(texts) - 5


def test_stages_take_repeated_and_null_ids_row_by_row(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(33)
    item, *clean = (prose(rng) for _ in range(6))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item), (7, item), (None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (8, clean[4])]
    kept = pipeline.without_benchmark(spark, documents(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(rows[2:], key=str)
    # Copies among rows of one id, and of none; one of them stays, by the smallest id.
    copies = [*rows[2:], (None, clean[0]), (7, clean[2]), (7, clean[3]), (None, clean[4])]
    kept = pipeline.without_near_copies(spark, documents(spark, copies), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(rows[2:], key=str)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(34)
    return documents(spark, [(1, None), (2, ""), (None, "no key at all here"), (3, prose(rng)), (3, prose(rng)),
                             (None, None), (4, "x " * 5000)])


@pytest.mark.parametrize("number", range(5))
def test_every_stage_takes_empty_tables_and_odd_rows(spark, small, odd, number):
    import corpus_pipeline as pipeline

    name, stage = pipeline.STAGES[number]
    assert stage(spark, empty(odd), small).count() == 0
    found = stage(spark, odd, small)
    rows = found.collect()
    # The three texts without a word are one group; nothing else goes.
    assert len(rows) == (5 if name == "simhash" else 7)
    assert found.columns == (pipeline.COLUMNS if number < 4 else ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_toxic_documents_go(spark, small):
    """The stage keeps what the query does not predict, with texts and further columns whole."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    gone = {r.doc_id for r in queries.op10_toxicity(spark, small).where("predicted = 1").collect()}
    kept = pipeline.without_toxic(spark, docs, small)
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.select(kept.columns).collect() if r.doc_id not in gone)
    assert gone

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import empty, odd_documents

from moorage.llm import crosstokens as c
from moorage.llm import queries


@pytest.fixture(scope="module")
def paths():
    return queries.byte_model(), queries.piece_model()


@pytest.fixture(scope="module")
def tools(paths):
    """Both libraries, and the bytes of their tokens from other files or by other calls."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        bytes_a = {int(n): base64.b64decode(t) for t, n in map(bytes.split, file)}
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.get_piece_size())
    ]
    return a, bytes_a, b, bytes_b


def groups(text, tools):
    """Groups as (A ids, B ids), by walking both token lists byte by byte; None without tokens."""
    a, bytes_a, b, bytes_b = tools
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(bytes_b[i] for i in ids_b) != whole:
        return None
    out, at_a, at_b, here = [], 0, 0, ([], [])
    ids_a, ids_b = ids_a[::-1], ids_b[::-1]
    while ids_a or ids_b:
        if at_a <= at_b and ids_a:
            here[0].append(ids_a.pop())
            at_a += len(bytes_a[here[0][-1]])
        else:
            here[1].append(ids_b.pop())
            at_b += len(bytes_b[here[1][-1]])
        if at_a == at_b:
            out.append(here)
            here = ([], [])
    return out


def brute(rows, tools):
    found = [(key, groups(text, tools)) for key, text in rows]
    counts = Counter()
    for _, gs in found:
        counts.update({(x, y) for left, right in gs or [] for x in left for y in right})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for key, gs in found:
        gs = gs or []
        links = [(x, y) for left, right in gs for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in gs)
        out.append((key, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links),
                    sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def linked(df, paths, **options):
    return sorted(map(tuple, c.token_links(df, *paths, **options).collect()), key=str)


def test_products_equal_dense_ones(monkeypatch):
    r = np.random.default_rng(1)
    for strip in (1 << 22, 5):
        monkeypatch.setattr(c, "_AT_ONCE", strip)
        for shape in [(3, 4, 5), (1, 1, 1), (0, 3, 2), (3, 0, 2), (9, 7, 8)]:
            a, b = (r.integers(0, 3, s) * (r.random(s) < 0.4) for s in (shape[:2], shape[1:]))
            sparse = [c.Sparse.of(*np.nonzero(m), m[np.nonzero(m)], m.shape) for m in (a, b)]
            product = sparse[0].times(sparse[1])
            dense = np.zeros((shape[0], shape[2]), np.int64)
            np.add.at(dense, (product.rows(), product.columns), product.values)
            assert (dense == a @ b).all() and len(product) == shape[0]
            assert (sparse[0].turned().times(sparse[0]).rows() >= 0).all()


def test_stretches_that_are_encoded_together(paths, tools):
    """Whatever stands beside it, a stretch has the tokens it has alone."""
    aligner = c.Aligner(*paths)
    texts = [" lead", "lead", "trail ", " ", "a  b", "\nx", "x\n", "plain", "'s", "  ", "é", "9"]
    aligner.learn(set(texts))
    for text in texts:
        want = groups(text, tools)
        found = aligner.rendered[aligner.known[text]]
        assert found == "".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for a, b in want)


def test_groups_equal_common_ends():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randint(1, 30)
        ends = [np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size})) for _ in range(2)]
        common = np.array(sorted(set(ends[0].tolist()) & set(ends[1].tolist())))
        for found, own in zip(c.groups_of(*ends), ends):
            assert found.tolist() == np.searchsorted(common, own).tolist()


ODD = [
    "", None, " ", "  two  spaces ", "\n", "\nlead", "tail \n", "a \n b", "tab\t tab \t", "x y z　 w   v",
    "▁ mark ▁▁", "a▁b c", "it's we'll 'tis <|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト \U0001f642‍\U0001f525",
    "\x00 nul \x1c sep \x85 next", "é ́x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345678901234567890 3.14",
    "Zürich naïve œuvre", "﻿bom", "᠎​", "a" * 3000, "ab " * 2000, "=" * 500 + " " * 500,
]


@pytest.mark.parametrize("hot", [0, 40, c.HOT_PAIRS])
def test_links_equal_brute_force(spark, monkeypatch, paths, tools, hot):
    """White space of all kinds, marks, special strings, scripts, runs; some texts repeat."""
    monkeypatch.setattr(c, "REMEMBERED", 60)
    monkeypatch.setattr(c, "_HELD", 100)
    rng = random.Random(3)
    alphabet = ["the ", "cat", "s ", "\n", "  ", "é", "'s ", "9", ". ", "Un", "believ", "able ", "\t", "日"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(150)]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no key"), (7, "another text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert linked(df, paths, hot_pairs=hot) == brute(rows, tools)


def test_given_documents(spark, paths, tools):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert linked(df, paths) == brute(rows, tools)


def test_odd_rows(spark, paths, tools):
    df = odd_documents(spark).withColumnsRenamed({"found": "row", "size": "pairs", "leaf": "n", "place": "best"})
    assert linked(df, paths) == brute([(r.doc_id, r.text) for r in df.collect()], tools)
    assert linked(empty(df), paths) == []

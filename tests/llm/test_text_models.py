from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest
from cases import empty, odd_documents
from pyspark.sql import functions as F

from moorage.llm import htmltext, langid, queries, sentencepieces, toxicity


@pytest.fixture(scope="module")
def tables():
    return "/root/testdata/sf0.01"


def test_pieces_equal_the_library():
    codec = sentencepieces.PieceCodec(queries.piece_model())
    rng = random.Random(8)
    alphabet = ["a", "the", " ", "  ", "▁", "\n", "é", "ß", "日", "🙂", "\x00", "1", ".", "Z", "ing"]
    texts = ["", " ", "▁", "a" * 2000, "<s> </s> <0x41>", " " * 40 + "x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    theirs = codec.library.encode(texts, num_threads=1)
    assert [codec.encode(t) for t in texts] == theirs
    assert [codec.decode(ids) for ids in theirs] == codec.library.decode(theirs, num_threads=1)


def test_long_words_take_the_same_pieces_in_short_time(monkeypatch):
    codec = sentencepieces.PieceCodec(queries.piece_model(), check=False)
    rng = random.Random(9)
    syllables = ["a", "b", "the", "ing", "é", "日本", "\x00", "🙂", "er", "qu", "7"]
    words = ["".join(rng.choices(syllables, k=k)) for k in (1, 2, 3, 300, 700)] + ["a" * 999, "ab" * 400, "日" * 300]
    theirs = codec.library.encode(words, num_threads=1)
    monkeypatch.setattr(sentencepieces, "LONG_WORD", 1)
    assert [codec.encode(w) for w in words] == theirs
    monkeypatch.undo()
    long = "".join(rng.choices("abcdefghij", k=1 << 20))
    began = time.process_time()
    found = codec.encode(long)
    assert time.process_time() - began < 30
    assert found == codec.library.encode(long)


def test_pieces_of_whole_table(spark, tables):
    found = queries.op3_sentencepiece(spark, tables)
    import hashlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in found.collect():
        ids = library.encode(texts[r.doc_id])
        want = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_pieces_of_odd_rows(spark):
    df = odd_documents(spark)
    found = sentencepieces.encode_decode(df, queries.piece_model())
    assert found.count() == df.count() and found.agg(F.max("unequal")).first()[0] == 0
    assert {r.n_tokens for r in found.where("doc_id in (1, 2)").collect()} == {0}
    assert sentencepieces.encode_decode(empty(df), queries.piece_model()).count() == 0


def test_languages_of_held_out_rows(spark, tables):
    found = queries.op4_language_id(spark, tables).where("held_out")
    truth = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang").dropna()
    right = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert found.where("score < 0 or score > 1").count() == 0


def test_words_come_before_grams_and_grams_get_shorter():
    tables = [{"cat": [-1.0, -9.0]}, {"c": [-5.0, -5.0], "x": [-4.0, -2.0]}, {"at": [-3.0, -4.0]}, {}, {}, {}]
    model = langid.LanguageModel(["en", "xx"], [0.0, 0.0], tables)
    assert model.word("cat") == [-1.0, -9.0]
    assert model.word("bat") == [-3.0, -4.0]
    assert model.word("xyz") == [-4.0, -2.0]
    assert model.word("ooo") == [0.0, 0.0]


def test_languages_of_odd_rows(spark):
    df = odd_documents(spark, [(7, "12 34 !"), (8, "plain words")])
    model = langid.learn(df)
    rows = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for key in (1, 2, 3, 7):
        assert (rows[key].lang_pred, rows[key].score) == ("und", 0.0)
    assert rows[8].lang_pred == "en" and langid.predict(df, model).count() == df.count()
    assert langid.predict(empty(df), model).count() == 0
    with pytest.raises(ValueError, match="labelled"):
        langid.learn(empty(df))


def test_rare_languages_come_whole_and_a_hot_key_brings_its_share():
    assert langid._shares({"de": 3, "en": 40_000}, 8_000) == {"de": 1.0, "en": 7_997 / 40_000}
    assert langid._shares({"a": 10, "b": 10}, 100) == {"a": 1.0, "b": 1.0}
    shares = langid._shares({"a": 100, "b": 1_000, "c": 10}, 90)
    assert sum(shares[name] * n for name, n in {"a": 100, "b": 1_000, "c": 10}.items()) == pytest.approx(90)


def test_scores_equal_the_model_by_definition(spark):
    rng = random.Random(32)
    words = {"en": ["the", "house", "stands", "water"], "de": ["das", "haus", "steht", "wasser"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(["en"] * 30 + ["de"] * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    asked = ["house water", "das unknown Wasser", "xyz", "stehts the"]
    terms = {lang: [Counter() for _ in range(langid.LONGEST_GRAM + 1)] for lang in words}
    for _, text, lang in rows:
        for word in text.split():
            terms[lang][0][word] += 1
            for size in range(1, langid.LONGEST_GRAM + 1):
                marked = f"<{word}>"
                terms[lang][size].update(marked[i : i + size] for i in range(len(marked) - size + 1))

    def log(lang, size, term):
        both = sum(terms[x][size][term] for x in words)
        if not both:
            return None
        every = sum(terms[x][size].total() for x in words)
        return math.log((terms[lang][size][term] + both / every) / (terms[lang][size].total() + 1))

    def word_log(lang, word):
        if (known := log(lang, 0, word)) is not None:
            return known
        for size in range(langid.LONGEST_GRAM, 0, -1):
            marked = f"<{word}>"
            grams = [marked[i : i + size] for i in range(len(marked) - size + 1)]
            known = [value for gram in grams if (value := log(lang, size, gram)) is not None]
            if known:
                return sum(known) / len(known)
        return 0.0

    found = langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), langid.learn(df))
    for r in found.collect():
        logs = {
            lang: math.log(n / 50) + sum(word_log(lang, w) for w in asked[r.doc_id].lower().split())
            for lang, n in (("en", 30), ("de", 20))
        }
        best = max(logs, key=logs.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))


def test_a_language_with_three_texts_is_found(spark):
    rng = random.Random(31)
    english = "the of and to in that was his with for have this from they will would there their what about".split()
    german = "der die und das nicht ein auch werden wurde durch zwischen über schon immer wieder keine".split()
    text = lambda words: " ".join(rng.choices(words, k=25))
    # One key holds a third of the rows.
    rows = [(i if i % 3 else 0, text(english), "en") for i in range(3_000)] + [(9_000 + i, text(german), "de") for i in range(3)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_documents=300)
    asked = spark.createDataFrame([(1, text(german)), (2, text(english))], "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.predict(asked, model).orderBy("doc_id").collect()] == ["de", "en"]


def test_a_hot_key_does_not_flood_the_toxic_sample(spark, monkeypatch):
    rows = [(1 if i % 2 else i, f"fine words number {i}") for i in range(2_000)] + [(5, "you awful scum")] * 500
    labels = spark.createDataFrame([(i, int(i == 5)) for i in range(2_000)], "doc_id bigint, toxic int")
    sizes = []
    fit = toxicity.ToxicityModel.fit_curve
    monkeypatch.setattr(toxicity.ToxicityModel, "fit_curve", lambda self, x, y: (sizes.append(len(x)), fit(self, x, y)))
    toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, max_documents=300)
    assert 150 < sizes[0] < 350


def brute_segments(scores):
    """Ruzzo and Tompa by definition: take the best segment, go on left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, _ = best
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return left + [best] + [(a + j, b + j, s) for a, b, s in right]


def test_segments_equal_the_definition():
    rng = random.Random(9)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 25))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_toxicity_of_held_out_rows(spark):
    tables = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "toxic")
    found = queries.op10_toxicity(spark, tables).where("held_out").join(labels, "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((1, 1), 0) >= 0.9 * (counts.get((1, 1), 0) + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.03 * counts[0, 0]


def test_toxicity_of_odd_rows(spark):
    df = odd_documents(spark, [(i, f"fine words {i}") for i in range(20, 60)] + [(i, f"you scum {i}") for i in range(60, 90)])
    rows = [(i, int(i >= 60)) for i in range(20, 90)] + [(20, 0), (None, 1), (21, None), (999, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    model = toxicity.learn(df, labels)
    found = toxicity.score(df, model)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == df.count() and rows[1].score == rows[2].score
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert toxicity.score(empty(df), model).count() == 0
    kept = toxicity.score(df, model, keep=["doc_id", "text", "source"])
    assert kept.columns[:3] == ["doc_id", "text", "source"] and kept.count() == df.count()


def test_main_text_of_unseen_layouts():
    model = htmltext.TreeModel().train(htmltext.labelled_pages(600))
    right = wrong = missed = 0
    for html, wanted in htmltext.labelled_pages(150, seed=77):
        lines = set(wanted.split("\n"))
        for text, chance in model.blocks(html):
            right += text in lines and chance >= 0.5
            wrong += text not in lines and chance >= 0.5
            missed += text in lines and chance < 0.5
    assert wrong < 0.04 * right and missed < 0.04 * right


def test_marginals_equal_enumeration():
    model = htmltext.TreeModel().train(htmltext.labelled_pages(100))
    nodes = htmltext.parse("<body><nav><a href=x>Home</a></nav><div class=content><p>Some words, yes.</p></div></body>")
    logs = [sum(model.logs.get(f, 0.0) for f in htmltext.features(n, nodes)) for n in nodes]
    import itertools
    import math

    mass, total = [0.0] * len(nodes), 0.0
    for states in itertools.product((0, 1), repeat=len(nodes)):
        weight = model.roots[states[0]]
        for at, node in enumerate(nodes):
            weight *= math.exp(max(-30.0, min(30.0, logs[at]))) if states[at] else 1.0
            if at:
                weight *= model.edges[htmltext.kind_of(node)][states[node.parent]][states[at]]
        total += weight
        for at, state in enumerate(states):
            mass[at] += weight * state
    assert model.marginals(nodes)[1:] == pytest.approx([m / total for m in mass][1:], abs=1e-6)


def test_pages(spark):
    article = "<article><h1>A  title</h1><p><b>One &amp; two,\n three.<br>Four.<p>Five words stand right here.</article>"
    page = f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/a>Home</a></ul></nav>{article}<footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<" * 500), (1, "u", page), (None, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, url string, html string, text int")
    found = htmltext.extract(df).collect()
    assert len(found) == len(rows)
    by_key = {r.page_id: r for r in found}
    assert by_key[1].text == "A title\nOne & two, three. Four.\nFive words stand right here."
    assert by_key[1].n_chars == len(by_key[1].text) and (by_key[2].text, by_key[3].text) == ("", "")
    assert htmltext.extract(empty(df)).count() == 0


def test_whole_pages_table(spark, tables):
    """The generated pages keep their article as it stands, and nothing else."""
    import html as entities
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    for r in queries.op1_html_text(spark, tables).collect():
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)
        if inside is None:
            continue
        text = re.sub("</?b>", "", re.sub("<br>", " ", re.sub("</?(?:h1|p)>", "\n", inside[1])))
        lines = [" ".join(entities.unescape(line).split()) for line in text.split("\n")]
        assert r.text == "\n".join(line for line in lines if line)

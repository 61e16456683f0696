from __future__ import annotations

import random

import duckdb
import pytest
from cases import empty, odd_documents

from moorage.llm import decontaminate, linededup, queries, urls


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, small, name):
    engine = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        engine.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    wanted = engine.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    found = queries.queries()[name](spark, small).select(*names).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted.fetchall(), key=str)


def test_urls(spark):
    rules = spark.createDataFrame(
        [("a.com", "/", "block"), ("a.com", "/ok/", "allow"), ("A.com", "/", "block"), ("b.a.com", "/", "allow"),
         ("com", "/x", "block"), (None, "/", "block"), ("", "/", "block")],
        "host string, path string, verdict string",
    )
    cases = {
        "http://a.com/": ("a.com/", "block"), "HTTP://X.A.COM/ok/1?q#f": ("a.com/ok/", "allow"),
        "http://b.a.com/xyz": ("b.a.com/", "allow"), "http://aa.com/xyz": ("com/x", "block"),
        "http://a.com": (None, "allow"), "http://a.com?x=/": (None, "allow"), "no scheme": (None, "allow"),
        "": (None, "allow"), None: (None, "allow"), "x://" + "l." * 3000 + "a.com/": ("a.com/", "block"),
    }
    rows = [(i, u, 1, "x") for i, u in enumerate(cases)]
    rows += [rows[0], (None, "http://a.com/", 1, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host int, rule string")
    found = urls.judge_urls(df, rules).collect()
    assert len(found) == len(rows)
    by_key = {r.page_id: (r.rule, r.verdict) for r in found}
    assert [by_key[i] for i in range(len(cases))] == list(cases.values())
    assert by_key[None] == ("a.com/", "block")
    assert urls.judge_urls(empty(df), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, empty(rules)).collect()} == {"allow"}


def brute_tiles(item, document, least):
    gone_a, gone_b, total = [0] * len(item), [0] * len(document), 0
    while True:
        best, size = None, least - 1
        for i in range(len(item)):
            for j in range(len(document)):
                k = 0
                while (i + k < len(item) and j + k < len(document) and item[i + k] == document[j + k]
                       and not gone_a[i + k] and not gone_b[j + k]):
                    k += 1
                if k > size:
                    best, size = (i, j), k
        if best is None:
            return total
        for k in range(size):
            gone_a[best[0] + k] = gone_b[best[1] + k] = 1
        total += size


def test_tiles_equal_the_definition():
    rng = random.Random(10)
    for _ in range(120):
        vocabulary = [b"a", b"b", b"c", b"d"][: rng.randint(2, 4)]
        item = [rng.choice(vocabulary) for _ in range(rng.randint(0, 16))]
        document = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        assert sum(t[2] for t in decontaminate.tiles(item, document, 3)) == brute_tiles(item, document, 3)


def test_contamination(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    a, b = passage.split()[:6], passage.split()[6:]
    benchmark = spark.createDataFrame(
        [(1, passage), (2, "too short"), (3, None), (4, "other words that never stand in any text here"), (1, passage)],
        "item_id bigint, text string",
    )
    rows = [(10, f"before {passage.upper()}, after"), (11, " ".join(b + ["then"] + a)), (12, " ".join(a[:5])),
            (13, "clean text with one two three only")]
    df = odd_documents(spark, rows)
    found = decontaminate.contamination(df, benchmark)
    assert found.count() == df.count()
    by_key = {r.doc_id: r for r in found.collect()}
    assert (by_key[10].item_id, by_key[10].covered, by_key[10].contaminated) == (1, 1.0, True)
    assert by_key[11].contaminated and by_key[11].covered == 1.0
    assert not by_key[12].contaminated and by_key[12].covered < 0.5
    assert (by_key[13].n_items, by_key[13].item_id, by_key[13].covered) == (0, None, 0.0)
    assert decontaminate.contamination(empty(df), benchmark).count() == 0
    assert decontaminate.contamination(df, empty(benchmark)).where("contaminated").count() == 0


def test_recurring_lines(spark):
    notice = "Page {} of the printed edition is here"
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    rows = [(i, f"{prose(12)}\n{prose(20)}\n{notice.format(i)}") for i in range(20, 26)]
    rows += [(40, "a copy of a line\nand one more line"), (41, "a copy of a line\nand one more line"),
             (42, "a copy of a line\nand one more line")]
    rows[0] = (20, rows[0][1] + "\n\nlast one stays as it stands, with  two spaces")
    df = odd_documents(spark, rows)
    found = linededup.drop_recurring_lines(df, min_documents=3)
    assert found.count() == df.count() and "leaf" in found.columns
    by_key = {r.doc_id: r for r in found.collect()}
    assert "Page" not in by_key[20].text and by_key[20].text.endswith("\n\nlast one stays as it stands, with  two spaces")
    assert by_key[40].text == rows[-1][1] and by_key[40].n_dropped == 0  # wholly a copy
    assert (by_key[1].text, by_key[1].n_lines, by_key[2].text, by_key[2].n_lines) == (None, 0, "", 1)
    assert linededup.drop_recurring_lines(empty(df)).count() == 0


def test_templates_of_variable_words(spark):
    rng = random.Random(22)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(30))
    # Two words of eleven vary, behind the leading ones that the tree goes down by.
    rows = [(i, f"the last user {name} has logged in from the office {name}\n{prose()}")
            for i, name in enumerate(["ann", "bob", "cid", "dan", "eve"])]
    rows += [(9, f"the last user of all things is quite another line here\n{prose()}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in linededup.drop_recurring_lines(df).collect()}
    # Half of the leaf's weight agrees on nine of eleven words; the odd line stays.
    assert [found[i].n_dropped for i in (0, 1, 2, 3, 4, 9)] == [1, 1, 1, 1, 1, 0]


def test_native_operators_run_no_python(spark, small):
    for name in ("op5_url_filter", "op9_line_dedup"):
        plan = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"
    ]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if number < 4:
            assert docs.columns == columns
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] == counts[5]
    whole = pipeline.run(spark, small)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_keeps_one_of_each_group(spark, small):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    base = [f"w{rng.randint(0, 999)}" for _ in range(400)]
    rows = [(i, " ".join(base)) for i in (5, 3, 9)] + [(20, "a text of its own with other words " + " ".join(base[:40][::-1]))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = pipeline.without_near_copies(spark, df, small).collect()
    assert sorted(r.doc_id for r in kept) == [3, 20]
    lines = pipeline.without_recurring_lines(spark, df, small).collect()
    assert sorted((r.doc_id, r.text) for r in lines) == sorted(rows)

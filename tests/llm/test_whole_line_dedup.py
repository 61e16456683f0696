from __future__ import annotations

import random

from moorage.llm import linededup

rng = random.Random(51)


def word():
    return "".join(rng.choices("abcdefghij", k=6))


def prose(n=30):
    return " ".join(word() for _ in range(n))


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r.text for r in linededup.drop_recurring_lines(df).collect()}


def test_several_templates_of_a_leaf(spark):
    # Twelve words, three in front: two templates of 10 lines each and 25 unrelated lines.
    rows, kept = [], {}
    for i in range(45):
        own = prose()
        line = {0: f"the last user {word()} has logged in from the office {word()}",
                1: f"the last user {word()} was sent away by guards at {word()}"}.get(i // 10)
        line = line + " today" if line else "the last user " + prose(9)
        rows.append((i, f"{line}\n{own}"))
        kept[i] = own if i < 20 else f"{line}\n{own}"
    assert found(spark, rows) == kept


def test_no_document_is_left_whole_and_copies_count_once(spark):
    # A passage in three unrelated texts, one of them nothing else but a short end.
    passage, a, b = prose(60), prose(), prose()
    rows = [(100, f"{passage}\n{a}"), (101, f"{passage}\nthe end"), (102, f"{b}\n{passage}")]
    kept = {100: a, 101: "the end", 102: b}
    # Copies, equal or near, do not make their lines recur; a line that stands elsewhere does.
    body, notice, more, c, d = "\n".join(prose() for _ in range(12)), prose(8), prose(5), prose(), prose()
    rows += [(i, f"{body}\n{notice}") for i in (200, 201, 202)]
    rows += [(203, f"{body}\n{notice}\n{more}"), (204, f"{notice}\n{c}"), (205, f"{notice}\n{d}")]
    kept |= {200: body, 201: body, 202: body, 203: f"{body}\n{more}", 204: c, 205: d}
    assert found(spark, rows) == kept


def test_a_passage_in_two_texts_recurs(spark):
    passage, a, b, c = prose(60), prose(), prose(), prose()
    rows = [(1, f"{passage}\n{a}"), (2, f"{b}\n{passage}"), (3, c), (4, c)]
    assert found(spark, rows) == {1: a, 2: b, 3: c, 4: c}


def test_helper_columns_take_free_names(spark):
    passage, a, b = prose(60), prose(), prose()
    rows = [(1, f"{passage}\n{a}", 1, 2, 3), (2, f"{b}\n{passage}", 4, 5, 6), (3, None, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __row int, __twin int, `_dropped` int")
    rows = linededup.drop_recurring_lines(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, a, 1, 2, 3, 2, 1), (2, b, 4, 5, 6, 2, 1), (3, None, 7, 8, 9, 0, 0)]

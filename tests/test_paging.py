"""Paged responses, against following the tokens one by one."""

from __future__ import annotations

import random

import pytest
from helpers import plan_of, rows_of

import moorage as m

PAGES = "listing string, ord bigint, token string, next_token string, body string, _page int, _listing string, pages int"


def brute(rows):
    answers = {}
    for listing, ord, token, after, body in sorted(rows, key=lambda r: r[1]):
        if listing is not None:
            answers.setdefault(listing, {}).setdefault(token or "", (after or None, body))
    found, chains = [], []
    for listing, pages in answers.items():
        at, seen = "", []
        while at in pages and at not in seen:
            seen.append(at)
            at = pages[at][0]
        found += [(listing, place, pages[token][1]) for place, token in enumerate(seen)]
        status = "headless" if not seen else "complete" if at is None else "cyclic" if at in seen else "broken"
        chains.append((listing, len(seen), len(pages) - len(seen), status))
    order = lambda row: tuple((v is None, str(v)) for v in row)
    return sorted(found, key=order), sorted(chains, key=order)


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", 2) for row in rows], PAGES).repartition(3)


def chain(listing, size, end=None):
    """Pages in a shuffled order of tokens; the last one asks for ``end``."""
    tokens = [None, *random.Random(size).sample(range(10 * size), size - 1)] if size > 1 else [None]
    names = [t if t is None else f"t{t}" for t in tokens]
    return [(listing, at * 7 % 1009, name, after, f"{listing}{at}")
            for at, (name, after) in enumerate(zip(names, [*names[1:], end(names) if end else None]))]


CASES = {
    "lengths": [row for n in (1, 2, 3, 4, 5, 8, 9, 33) for row in chain(f"l{n}", n)],
    "cycles": chain("own", 6, lambda t: t[-1]) + chain("middle", 9, lambda t: t[3]) + chain("start", 5, lambda t: t[1])
    + [("pair", 1, None, "a", "x"), ("pair", 2, "a", "b", "y"), ("pair", 3, "b", "a", "z")],
    "broken": chain("gone", 7, lambda t: "nowhere") + chain("short", 1, lambda t: "nowhere"),
    "headless": [("h", 1, "a", "b", "x"), ("h", 2, "b", None, "y")],
    "unread": chain("u", 4) + [("u", 900, "side", "t0", "x"), ("u", 901, "loop", "loop", "y")],
    "answered twice": [("r", 5, "", "a", "old"), ("r", 9, None, "b", "new"), ("r", 6, "a", "", "one"), ("r", 7, "b", None, "two"),
                       ("r", 8, "a", "b", "late")],
    "nulls": [(None, 1, None, "a", "x"), (None, 2, "a", None, "y"), ("n", 3, None, None, None)],
}


@pytest.mark.parametrize("case", [*CASES, "all"])
def test_chains_equal_following(spark, case):
    rows = CASES[case] if case != "all" else [row for part in CASES.values() for row in part]
    pages, (found, chains) = frame(spark, rows), brute(rows)
    assert rows_of(m.follow_pages(pages, keep=["body"])) == found
    assert rows_of(m.page_chains(pages)) == chains


def test_names_of_columns_may_clash(spark):
    pages = frame(spark, CASES["lengths"])
    kept = m.follow_pages(pages, keep=["_page", "_listing", "pages"])
    assert kept.columns == ["listing", "page_no", "_page", "_listing", "pages"]
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, "x", 2)}


def test_empty_table(spark):
    pages = frame(spark, CASES["lengths"]).limit(0)
    assert m.follow_pages(pages).count() == 0 and m.page_chains(pages).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    from moorage.operators import paging

    tables, write = [], paging.written
    monkeypatch.setattr(paging, "written", lambda df, name: (tables.append(name), write(df, name))[1])
    rows = chain("long", 300)
    found = m.follow_pages(frame(spark, rows))
    assert found.count() == 300 and tables.count("page-jumps") <= 11
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)


def test_chains_over_many_slices_equal_following(spark, monkeypatch):
    """Paths are cut by slices, in every shape of chain."""
    from moorage.operators import paging

    monkeypatch.setattr(paging, "_SLICE_ROWS", 6)
    rows = [row for part in CASES.values() for row in part]
    pages, (found, chains) = frame(spark, rows), brute(rows)
    assert rows_of(m.follow_pages(pages, keep=["body"])) == found
    assert rows_of(m.page_chains(pages)) == chains


def test_random_links_equal_following(spark, monkeypatch):
    """Any answer may lead to any other: side chains, cycles, ends in the middle of other chains."""
    from moorage.operators import paging

    monkeypatch.setattr(paging, "_SLICE_ROWS", 40)
    rng = random.Random(3)
    names = [None, *(f"t{i}" for i in range(30))]
    rows = [(f"l{at}", 40 * at + place, name, rng.choice([*names, "none"]), f"b{place}")
            for at in range(12) for place, name in enumerate(rng.sample(names, len(names)))]
    pages, (found, chains) = frame(spark, rows), brute(rows)
    assert rows_of(m.follow_pages(pages, keep=["body"])) == found
    assert rows_of(m.page_chains(pages)) == chains


def test_only_what_leads_out_of_a_slice_is_followed_in_rounds(spark, monkeypatch):
    """The rows of all rounds together are few beside the pages, not a multiple of them."""
    from moorage.operators import paging

    moved, write = [], paging.written

    def counting(df, name):
        made = write(df, name)
        if name in ("page-jumps", "pages-known"):
            moved.append(made.count())
        return made

    monkeypatch.setattr(paging, "written", counting)
    monkeypatch.setattr(paging, "_SLICE_ROWS", 100, raising=False)
    rows = [("long", at, f"t{at}" if at else None, f"t{at + 1}" if at < 599 else None, "x") for at in range(600)]
    assert rows_of(m.page_chains(frame(spark, rows))) == [("long", 600, 0, "complete")]
    assert sum(moved) < 200

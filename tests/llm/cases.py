"""Small inputs and brute-force answers."""

from __future__ import annotations

import re

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def odd_documents(spark, rows=()):
    """NULLs, empty and repeated rows, a long text, and columns with names used inside."""
    texts = [(1, None), (2, ""), (3, "  \n \t"), (None, "no key at all here"), (4, "x " * 30_000),
             (5, "same text twice\nin two lines"), (5, "same text twice\nin two lines"),
             (6, "\U0001f642 ünïcode ▁ 日本語 \x00 end"), *rows]
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, _row int, fp int, "
              "leaf int, place int, seeds string, n_lines int, size int, found string")
    return spark.createDataFrame(
        [(i, t, "en" if i and i % 2 else None, "s", 0, 1, 2, 3, 4, "x", 5, 6, "y") for i, t in texts], schema
    )


def empty(df):
    return df.limit(0)


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def roots(keys: list, links: list[tuple[int, int]]) -> list:
    """The smallest key reachable from each index."""
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, key in enumerate(keys):
        r = find(i)
        least[r] = key if r not in least else min(least[r], key)
    return [least[find(i)] for i in range(len(keys))]

"""Paged responses: pages put in the order of their continuation tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# Answers that one task puts in paths.
_SLICE_ROWS = 500_000


def _answers(pages: DataFrame, listing: str, token: str, next_token: str, ord: str) -> DataFrame:
    """(_listing, _token, _next, _ord): the first answer to each token; '' asks for the first page."""
    asked = pages.where(F.col(listing).isNotNull()).select(
        F.col(listing).alias("_listing"),
        F.coalesce(F.col(token), F.lit("")).alias("_token"),
        F.nullif(F.col(next_token), F.lit("")).alias("_next"),
        F.col(ord).alias("_ord"),
    )
    first = F.min_by(F.struct("_next"), "_ord")["_next"]
    return asked.groupBy("_listing", "_token").agg(first.alias("_next"), F.min("_ord").alias("_ord"))


def _path_finder():
    """Puts the answers of one slice in paths, for ``mapInArrow``.

    A path is a run of answers each of which asks for the next; every answer is in one path.
    Where several ask for the same one, the first goes on with it, and a cycle is cut at its first
    answer. The function is nested so that it travels by value.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [batch for batch in batches if batch.num_rows]
        if not filled:
            return
        rows = pa.Table.from_batches(filled)
        n = rows.num_rows

        def numbers(*names: str) -> np.ndarray:
            values = pa.chunked_array([c for name in names for c in rows[name].chunks])
            kind = pa.large_string() if pa.types.is_string(values.type) else values.type
            codes = values.cast(kind).combine_chunks().dictionary_encode().indices
            return codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

        listing, names = numbers("_listing"), numbers("_token", "_next")
        token, after = names[:n], names[n:]
        width = int(names.max()) + 1
        order = np.argsort(listing * width + token)
        keys = (listing * width + token)[order]
        found = np.minimum(np.searchsorted(keys, listing * width + after), n - 1)
        to = np.where((after >= 0) & (keys[found] == listing * width + after), order[found], -1)
        before = np.full(n, -1, np.int64)
        leading = np.flatnonzero(to >= 0)[::-1]
        before[to[leading]] = leading

        def ranked() -> tuple[np.ndarray, np.ndarray]:
            """The head of each answer's path and its steps from there; on a cycle the head has one before."""
            head = np.where(before >= 0, before, np.arange(n))
            steps = (before >= 0).astype(np.int64)
            for _ in range(n.bit_length()):
                steps, head = steps + steps[head], head[head]
            return head, steps

        head, steps = ranked()
        if (before[head] >= 0).any():
            least, jump = np.arange(n), np.where(before >= 0, before, np.arange(n))
            for _ in range(n.bit_length()):
                least, jump = np.minimum(least, least[jump]), jump[jump]
            before[(before[head] >= 0) & (least == np.arange(n))] = -1
            head, steps = ranked()
        last = np.ones(n, bool)
        last[before[before >= 0]] = False
        path = head + (TaskContext.get().partitionId() << 32)
        for name, column in (("_path", path), ("_off", steps), ("_last", last)):
            rows = rows.append_column(name, pa.array(column))
        yield from rows.combine_chunks().to_batches(max_chunksize=10_000)

    return paths


def _reached(answers: DataFrame) -> DataFrame:
    """``answers`` with ``_page``: the place that a chain of tokens reaches it at, from 0; else NULL.

    Answers are cut into slices of (listing, position) and put in paths within a slice. Only what
    leads from path to path is then followed over all: an entry is a place in a path that a
    listing begins at or another path leads to. Small listings, and long ones whose answers
    came about in the order of their tokens, have few of these.

    Jumps double: when the first n entries of every listing are known with the entry n further
    on of each, one join gives the next n, another the jumps of 2n. So the number of rounds is the
    logarithm of the most entries, and all listings advance together. A chain that returns to
    an entry keeps its first place there and brings no new ones.
    """
    slices = -(-answers.count() // _SLICE_ROWS) or 1
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in answers.schema)
    in_paths = answers.repartitionByRange(slices, "_listing", "_ord").mapInArrow(
        _path_finder(), f"{kinds}, _path bigint, _off bigint, _last boolean"
    )
    placed = written(in_paths, "page-paths")
    entry = ["_path", "_off"]
    lasts = placed.where("_last").select("_path", "_listing", F.col("_next").alias("_token"), (F.col("_off") + 1).alias("_length"))
    lasts = written(lasts, "page-path-ends")
    # A token that nobody answers leads nowhere.
    leads = lasts.where(F.col("_token").isNotNull()).join(
        placed.select("_listing", "_token", F.col("_path").alias("_to"), F.col("_off").alias("_to_off")), ["_listing", "_token"]
    )
    leads = written(leads.select("_path", "_length", "_to", "_to_off"), "page-leads")
    first = written(placed.where("_token = ''").select(*entry), "page-firsts")
    entries = first.unionByName(leads.select(F.col("_to").alias("_path"), F.col("_to_off").alias("_off"))).distinct()
    steps = entries.join(leads, "_path").select(*entry, "_to", "_to_off", (F.col("_length") - F.col("_off")).alias("_pages"))
    jumps = written(steps, "page-jumps")
    known = written(first.select(*entry, F.lit(0).cast("bigint").alias("_page")), "pages-known")
    count = known.count()
    while True:
        further = known.join(jumps, entry).select(
            F.col("_to").alias("_path"), F.col("_to_off").alias("_off"), (F.col("_page") + F.col("_pages")).alias("_page")
        )
        grown = known.unionByName(further).groupBy(*entry).agg(F.min("_page").alias("_page"))
        known = written(grown, "pages-known")
        before, count = count, known.count()
        if count == before:
            break
        onward = jumps.select(
            F.col("_path").alias("_to"), F.col("_off").alias("_to_off"),
            F.col("_to").alias("_far"), F.col("_to_off").alias("_far_off"), F.col("_pages").alias("_more"),
        )
        doubled = jumps.join(onward, ["_to", "_to_off"]).select(
            *entry, F.col("_far").alias("_to"), F.col("_far_off").alias("_to_off"), (F.col("_pages") + F.col("_more")).alias("_pages")
        )
        jumps = written(doubled, "page-jumps")
    # A path is entered anew only before the place it was entered at, and from there no new page comes.
    entered = known.groupBy("_path").agg(F.collect_list(F.struct("_off", "_page")).alias("_entries"))
    ways = F.filter("_entries", lambda e: e["_off"] <= F.col("_off"))
    page = F.array_min(F.transform(ways, lambda e: e["_page"] + F.col("_off") - e["_off"]))
    return (
        placed.join(written(entered, "paths-entered"), "_path", "left")
        .select(*answers.columns, page.alias("_page"))
    )


def follow_pages(
    pages: DataFrame,
    *,
    listing: str = "listing",
    token: str = "token",
    next_token: str = "next_token",
    ord: str = "ord",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(listing, page_no, keep...): the pages of every listing in the order of their tokens, from 0.

    ``token`` is what a page was asked with, NULL or empty for the first page of its listing;
    ``next_token`` asks for the page after it, NULL or empty at the end. If a token was answered
    several times, the answer with the smallest ``ord`` counts, whose values are unique
    within a listing. Pages that the first one does not lead to, and rows without a listing,
    are left out; ``page_chains`` tells how each listing ended.
    """
    answers = written(_answers(pages, listing, token, next_token, ord), "page-answers")
    places = _reached(answers).where(F.col("_page").isNotNull()).select("_listing", "_ord", "_page")
    rows = pages.select(F.col(listing).alias("_listing"), F.col(ord).alias("_ord"), F.struct(F.lit(0).alias("_"), *keep).alias("_kept"))
    found = rows.join(places, ["_listing", "_ord"])
    kept: list[Column] = [F.col("_kept")[name].alias(name) for name in keep]
    return found.select(F.col("_listing").alias(listing), F.col("_page").alias("page_no"), *kept)


def page_chains(
    pages: DataFrame,
    *,
    listing: str = "listing",
    token: str = "token",
    next_token: str = "next_token",
    ord: str = "ord",
) -> DataFrame:
    """(listing, pages, unread, status): how the chain of each listing ended.

    ``pages`` are reached from the first page, ``unread`` are answered but never led to.
    ``status`` is ``complete``, ``broken`` if the last page's token has no answer, ``cyclic`` if
    it leads back, or ``headless`` without a first page. Columns are as for ``follow_pages``.
    """
    answers = written(_answers(pages, listing, token, next_token, ord), "page-answers")
    last = F.max_by(F.struct("_next"), "_page")["_next"]
    ends = _reached(answers).groupBy("_listing").agg(
        F.count("_page").alias("pages"),
        F.count_if(F.col("_page").isNull()).alias("unread"),
        last.alias("_next"),
    )
    ends = written(ends, "chain-ends")
    # Only the answers to the last pages' tokens, so that this join moves few rows.
    asked = ends.select("_listing", "_next").join(
        answers.select("_listing", F.col("_token").alias("_next"), F.lit(True).alias("_answered")), ["_listing", "_next"]
    )
    status = (
        F.when(F.col("pages") == 0, "headless")
        .when(F.col("_next").isNull(), "complete")
        .when(F.col("_answered"), "cyclic")
        .otherwise("broken")
    )
    return ends.join(asked, ["_listing", "_next"], "left").select(
        F.col("_listing").alias(listing), "pages", "unread", status.alias("status")
    )

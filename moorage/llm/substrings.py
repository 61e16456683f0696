"""Repeated byte strings across documents, by suffix arrays of content-made shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_group, group_bounds, joined_bytes, map_rows
from .components import cut
from .suffixes import repeated_windows

LENGTH = 400
# Bytes of the short strings whose smallest hash in a window names the window's anchor.
GRAM = 48
# Bytes of text that one suffix array is built over, about; the same bounds what a worker
# holds. Anchors with more bytes of different pieces than HEAVY take one row per window.
SHARD_BYTES = 1 << 20
HEAVY = 4 << 20
# Bytes of text whose windows are hashed in one go: the arrays stay in the processor's cache.
HASHED_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    steps = np.full(max(count, 1), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)[:count]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row, by minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, axis=1).reshape(-1)
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def pieces_of(data: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Runs of windows with one anchor: (row, first window, windows, anchor, again).

    Equal windows have equal anchors wherever they stand, so two equal windows are in pieces
    with one anchor. ``again`` says that the anchor stands in the piece more than once,
    without which a window cannot repeat within its piece. Offsets count from the row's start.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none.astype(bool)
    gram = min(GRAM, length)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, n), out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1)
    grams ^= grams >> np.uint64(32)
    grams *= _MIX
    grams ^= grams >> np.uint64(29)
    # The hash above, the place below: the least is the leftmost of the smallest hash.
    # No row is longer than the place can hold.
    low = np.uint64((1 << 31) - 1)
    marked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(marked, length - gram + 1)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = rows[: n - length + 1] == rows[length - 1 :]
    window = np.flatnonzero(whole)
    if not len(window):
        return none, none, none, none, none.astype(bool)
    place = (least[window] & low).astype(np.int64)
    anchor, row = grams[place], rows[window]
    first = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
    moved = np.append(False, place[1:] != place[:-1]) & ~first
    begin = np.flatnonzero(first)
    counts = np.diff(np.append(begin, len(window)))
    again = np.add.reduceat(moved, begin) > 0
    return row[begin], window[begin] - starts[row[begin]], counts, anchor[begin].view(np.int64), again


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching [begin, end) spans as maximal runs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], axis=1)


def _runs(places: np.ndarray) -> list[dict]:
    """Sorted window starts as runs (a, b): windows a to b, both included."""
    if not len(places):
        return []
    first = np.flatnonzero(np.append(True, np.diff(places) > 1))
    last = np.append(first[1:] - 1, len(places) - 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(places[first].tolist(), places[last].tolist())]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def remove_repeated(
    documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """(key, text, n_bytes, n_removed, n_spans, kept_sha256), one row per document row.

    Texts are UTF-8 bytes. Every byte that a string of ``length`` bytes covers which also
    starts anywhere else, in this document or another, is removed; all occurrences are,
    and strings are judged on the input. ``n_spans`` counts maximal removed runs; ``text`` is
    what is left, with the replacement character where a removed run cut a character.

    NULL texts count as empty; texts shorter than ``length`` stay whole. A repeated row is
    another document, so its windows occur elsewhere. Rows that agree in key and text
    are treated alike. Further columns are left out; an empty table gives no rows.

    1. Each window of ``length`` bytes has an anchor: its smallest hash of GRAM bytes. Windows
       in a row with one anchor are a piece. Anchors are counted, and only pieces whose
       anchor stands in two places can hold a repeated window.
    2. Equal pieces enter once with their number. Pieces of one anchor go to one shard, where
       a suffix array and its common prefixes tell the windows that occur again.
    3. An anchor with too many different pieces for one shard sends a digest of each of its
       windows to be counted instead.
    """
    kind = documents.schema[key].dataType.simpleString()
    held = documents.select(
        F.col(key).alias("_key"),
        F.xxhash64(F.col(key), F.col(text)).alias("_row"),
        F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("_twin"),
        F.col(text).alias("_text"),
    )
    identity = held.select("_row", "_twin", "_text")

    def anchors(batch):
        data, starts = joined_bytes(batch.column(0))
        _, _, _, anchor, again = pieces_of(data, starts, length)
        found, where = np.unique(anchor, return_inverse=True)
        counts = np.bincount(where, weights=1.0 + again, minlength=len(found)) if len(found) else found
        return {"anchor": pa.array(found, pa.int64()), "places": pa.array(counts.astype(np.int64), pa.int64())}

    counted = map_rows(identity.select("_text"), anchors, "anchor bigint, places bigint", "_text", HASHED_BYTES)
    active = cut(counted.groupBy("anchor").agg(F.sum("places").alias("places")).where("places > 1").select("anchor"))

    def pieces(batch):
        data, starts = joined_bytes(batch.column(2))
        row, begin, windows, anchor, again = pieces_of(data, starts, length)
        whole = data.tobytes()
        at = (starts[row] + begin).tolist()
        digests = [
            xxhash.xxh3_128_digest(whole[a : a + w + length - 1]) for a, w in zip(at, windows.tolist())
        ]
        take = pa.array(row)
        return {
            "_row": batch.column(0).take(take),
            "_twin": batch.column(1).take(take),
            "begin": pa.array(begin, pa.int32()),
            "windows": pa.array(windows, pa.int32()),
            "anchor": pa.array(anchor, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
        }

    schema = "_row bigint, _twin bigint, begin int, windows int, anchor bigint, digest binary"
    instances = cut(map_rows(identity, pieces, schema, "_text", HASHED_BYTES).join(active, "anchor"))
    distinct = instances.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("times"),
        F.min(F.struct("_row", "_twin", "begin")).alias("where"),
        F.first("windows").alias("windows"),
    )
    wanted = distinct.select("where.*", "anchor", "digest", "times", "windows")
    listed = wanted.groupBy("_row", "_twin").agg(
        F.collect_list(F.struct("anchor", "digest", "times", "begin", "windows")).alias("wanted")
    )

    def cut_out(batch):
        texts = batch.column(0).cast(pa.large_binary()).to_pylist()
        found = [
            (w["anchor"], w["digest"], w["times"], t[w["begin"] : w["begin"] + w["windows"] + length - 1])
            for t, parts in zip(texts, batch.column(1).to_pylist())
            for w in parts
        ]
        columns = list(zip(*found)) if found else [[], [], [], []]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return {
            name: pa.array(list(column), kind_)
            for name, column, kind_ in zip(("anchor", "digest", "times", "bytes"), columns, kinds)
        }

    with_text = identity.join(listed, ["_row", "_twin"]).select("_text", "wanted")
    cut_pieces = map_rows(
        with_text, cut_out, "anchor bigint, digest binary, times bigint, bytes binary", "_text"
    )
    heavy = cut(
        distinct.groupBy("anchor")
        .agg(F.sum(F.col("windows").cast("bigint") + length).alias("_bytes"))
        .where(F.col("_bytes") > HEAVY)
        .select("anchor")
    )
    if heavy.isEmpty():
        light = cut_pieces
        by_window = None
    else:
        cut_pieces = cut(cut_pieces)
        light = cut_pieces.join(heavy, "anchor", "left_anti")
        by_window = _by_window(cut_pieces.join(heavy, "anchor", "left_semi"), length)

    def sort(table: pa.Table) -> pa.Table:
        bounds = group_bounds(table, ["anchor"])
        anchor = table.column("anchor").to_numpy()
        digests = table.column("digest").to_pylist()
        times = table.column("times").to_pylist()
        values = table.column("bytes").to_pylist()
        out: list[tuple[int, bytes, list[dict]]] = []
        shard: list[int] = []
        size = 0

        def flush() -> None:
            found = repeated_windows([values[r] for r in shard], [times[r] for r in shard], length)
            out.extend((int(anchor[r]), digests[r], _runs(p)) for r, p in zip(shard, found) if len(p))

        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            # A row of documents that occurs twice was cut twice: a piece enters once.
            rows = list({digests[r]: r for r in range(start, end)}.values())
            if len(rows) == 1 and times[rows[0]] == 1 and len(values[rows[0]]) == length:
                continue
            shard += rows
            size += sum(len(values[r]) for r in rows)
            if size >= SHARD_BYTES:
                flush()
                shard, size = [], 0
        if shard:
            flush()
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table(
            {
                "anchor": pa.array(columns[0], pa.int64()),
                "digest": pa.array(columns[1], pa.binary()),
                "runs": pa.array(columns[2], _RUNS),
            }
        )

    covered = by_group(light, ["anchor"], sort, "anchor bigint, digest binary, runs array<struct<a: int, b: int>>")
    if by_window is not None:
        covered = covered.unionByName(by_window)
    covered = cut(covered)
    spans = (
        instances.join(covered, ["anchor", "digest"])
        .select("_row", "_twin", "begin", F.explode("runs").alias("run"))
        .groupBy("_row", "_twin")
        .agg(
            F.collect_list(
                F.struct(
                    (F.col("begin") + F.col("run.a")).alias("a"), (F.col("begin") + F.col("run.b") + length).alias("b")
                )
            ).alias("spans")
        )
    )
    joined = held.join(spans, ["_row", "_twin"], "left").select("_key", "_text", "spans")

    def remove(batch):
        kept, sizes, removed, counts, digests = [], [], [], [], []
        values = batch.column(1).cast(pa.large_binary()).to_pylist()
        for value, found in zip(values, batch.column(2).to_pylist()):
            value = value or b""
            sizes.append(len(value))
            if found:
                runs = _merged(np.array([(s["a"], s["b"]) for s in found], np.int64))
                ends = [0, *runs[:, 1].tolist()]
                value = b"".join(value[a:b] for a, b in zip(ends, [*runs[:, 0].tolist(), len(value)]))
            counts.append(len(runs) if found else 0)
            removed.append(sizes[-1] - len(value))
            digests.append(hashlib.sha256(value).hexdigest())
            kept.append(value.decode(errors="replace"))
        return {
            key: batch.column(0),
            "text": pa.array(kept, pa.string()),
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(counts, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }

    return map_rows(
        joined,
        remove,
        f"{key} {kind}, text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "_text",
    )


def _by_window(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, runs) of heavy anchors, by counting a digest of every window."""

    def windows(batch):
        anchors, digests, times, places, found = [], [], [], [], []
        for anchor, digest, n, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
            count = len(value) - length + 1
            found.extend(xxhash.xxh3_128_digest(value[i : i + length]) for i in range(count))
            places.extend(range(count))
            anchors.extend([anchor] * count)
            digests.extend([digest] * count)
            times.extend([n] * count)
        return {
            "anchor": pa.array(anchors, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "times": pa.array(times, pa.int64()),
            "place": pa.array(places, pa.int32()),
            "window": pa.array(found, pa.binary()),
        }

    # A row of documents that occurs twice was cut twice: a piece enters once.
    once = pieces.dropDuplicates(["anchor", "digest"])
    rows = map_rows(
        once, windows, "anchor bigint, digest binary, times bigint, place int, window binary", "bytes"
    )
    again = cut(rows.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window"))

    def runs(batch):
        return {
            "anchor": batch.column(0),
            "digest": batch.column(1),
            "runs": pa.array([_runs(np.array(p, np.int64)) for p in batch.column(2).to_pylist()], _RUNS),
        }

    found = rows.join(again, "window").groupBy("anchor", "digest").agg(F.array_sort(F.collect_list("place")).alias("p"))
    return map_rows(found, runs, "anchor bigint, digest binary, runs array<struct<a: int, b: int>>")

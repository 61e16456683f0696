"""Benchmark passages in documents, found by greedy string tiling over shared word seeds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import joined_bytes, map_rows
from .components import cut

SEED_WORDS = 5
COVERAGE = 0.5
# Bits of the seed filter for each seed of the benchmark, and its largest size (32 MB).
_BITS_PER_SEED, _MOST_BITS = 64, 1 << 28
_BUCKET = 32768
_PROBES = 4

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
# Bytes as they count: letters lower-cased, digits, all beyond ASCII; the rest separates.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _powers(base: np.uint64, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    if count:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def word_hashes(column: pa.Array, fold: bytes = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the row of each word.

    ``fold`` gives each byte as it counts; words stand between spaces. A running sum of bytes times powers gives the polynomial hash of any range.
    """
    data, starts = joined_bytes(column)
    # A separator after every text keeps words apart at the seams.
    folded = np.frombuffer(fold, np.uint8)[data]
    places = starts[1:-1]
    folded = np.insert(folded, places, np.uint8(32)) if len(places) else folded
    begins_of = starts[:-1] + np.arange(len(starts) - 1)
    inside = np.concatenate([[False], folded != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(folded)), out=sums[1:])
    shift = _powers(_INVERSE, len(folded) + 1)
    hashes = _mixed((sums[end] - sums[begin]) * shift[begin])
    rows = np.searchsorted(begins_of, begin, side="right") - 1
    return hashes, rows


def seed_hashes(hashes: np.ndarray) -> np.ndarray:
    """Rolling hash of every SEED_WORDS words in a row."""
    count = max(0, len(hashes) - SEED_WORDS + 1)
    out = np.zeros(count, np.uint64)
    for step in range(SEED_WORDS):
        out = out * _BASE + hashes[step : step + count]
    return _mixed(out)


def _seeds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all texts and the row of each."""
    hashes, rows = word_hashes(column)
    seeds = seed_hashes(hashes)
    first, last = rows[: len(seeds)], rows[SEED_WORDS - 1 :][: len(seeds)]
    whole = first == last
    return seeds[whole], first[whole]


def _probes(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    step = (seeds >> np.uint64(32)) | np.uint64(1)
    return [((seeds + np.uint64(i) * step) & mask).astype(np.int64) for i in range(_PROBES)]


def tiles(item: list[bytes], document: list[bytes], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length), longest match first.

    Windows of ``least`` words are found by a running Karp-Rabin hash and compared word by
    word. Windows that follow each other on one diagonal make a maximal match. The longest
    match with unmarked words only is marked on both sides; one that is partly marked is
    cut to its unmarked runs and waits for its new length. At ties the earlier item
    position wins, then the earlier document position.
    """
    codes: dict[bytes, int] = {}
    first = np.array([codes.setdefault(w, len(codes)) for w in item], np.uint64)
    second = np.array([codes.get(w, len(codes) + 1) for w in document], np.uint64)
    if len(first) < least or len(second) < least:
        return []

    def windows(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) - least + 1, np.uint64)
        for step in range(least):
            out = out * _BASE + _mixed(values[step : step + len(out)] + np.uint64(1))
        return out

    known: dict[int, list[int]] = {}
    for at, value in enumerate(windows(first).tolist()):
        known.setdefault(value, []).append(at)
    mine = windows(second)
    runs: dict[int, list[list[int]]] = {}
    for j in np.flatnonzero(np.isin(mine, np.fromiter(known, np.uint64, len(known)))).tolist():
        for i in known[int(mine[j])]:
            if item[i : i + least] != document[j : j + least]:
                continue
            diagonal = runs.setdefault(j - i, [])
            if diagonal and diagonal[-1][1] == i - 1:
                diagonal[-1][1] = i
            else:
                diagonal.append([i, i])
    agenda = [
        (-(end - start + least), start, start + shift) for shift, parts in runs.items() for start, end in parts
    ]
    heapq.heapify(agenda)
    marked_item, marked_document = bytearray(len(item)), bytearray(len(document))
    found = []
    while agenda:
        size, i, j = heapq.heappop(agenda)
        size = -size
        if not any(marked_item[i : i + size]) and not any(marked_document[j : j + size]):
            marked_item[i : i + size] = b"\1" * size
            marked_document[j : j + size] = b"\1" * size
            found.append((i, j, size))
            continue
        run = 0
        for step in range(size + 1):
            if step < size and not marked_item[i + step] and not marked_document[j + step]:
                run += 1
                continue
            if run >= least:
                heapq.heappush(agenda, (-run, i + step - run, j + step - run))
            run = 0
    return found


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """(key, n_items, item_id, covered, contaminated), one row per document row.

    ``covered`` is the largest share of an item's words that greedy tiles of at least
    SEED_WORDS words cover in the document, ``item_id`` the item that has it (the smallest at
    ties) and ``n_items`` the number of items covered by ``coverage`` or more;
    ``contaminated`` says that there is one. Without a shared seed: 0, NULL, 0.0, false.

    Documents first pass a bit filter of the benchmark's seeds, whose size is bounded; only
    those with a hit are joined by seed with items. Every pair with a shared seed is tiled.
    NULL texts and items shorter than SEED_WORDS words match nothing; repeated rows stay;
    further columns are left out.
    """
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("item_text"))
    items = items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).distinct()

    def item_seeds(batch):
        seeds, rows = _seeds(batch.column(1))
        pairs = np.unique(np.stack([seeds.view(np.int64), rows]), axis=1)
        return {
            "seed": pa.array(pairs[0], pa.int64()),
            "item_id": batch.column(0).take(pa.array(pairs[1])),
        }

    item_kind = items.schema["item_id"].dataType.simpleString()
    listed = cut(map_rows(items, item_seeds, f"seed bigint, item_id {item_kind}", "item_text"))
    bits = 1 << 16
    while bits < min(listed.count() * _BITS_PER_SEED, _MOST_BITS):
        bits *= 2

    def positions(batch):
        seeds = batch.column(0).to_numpy().view(np.uint64)
        return {"position": pa.array(np.unique(np.concatenate(_probes(seeds, bits))), pa.int64())}

    spots = map_rows(listed.select("seed"), positions, "position bigint")
    buckets = (
        spots.groupBy(F.floor(F.col("position") / _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("position") % _BUCKET).alias("bitmap"))
        .collect()
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in buckets:
        start = row["bucket"] * (_BUCKET // 8)
        part = np.frombuffer(row["bitmap"], np.uint8)[: len(bitmap) - start]
        bitmap[start : start + len(part)] = part
    shared = documents.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def hits(batch):
        filter_bits = np.frombuffer(shared.value, np.uint8)
        seeds, rows = _seeds(batch.column(1))
        kept = np.ones(len(seeds), bool)
        for probe in _probes(seeds, bits):
            kept &= (filter_bits[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1
        seeds, rows = seeds[kept], rows[kept]
        found: list = [[] for _ in range(batch.num_rows)]
        for row, seed in zip(rows.tolist(), seeds.view(np.int64).tolist()):
            found[row].append(seed)
        found = [sorted(set(f)) for f in found]
        texts = batch.column(1)
        held = pa.array([t if f else None for t, f in zip(texts.to_pylist(), found)], pa.string())
        return {key: batch.column(0), "seeds": pa.array(found, pa.list_(pa.int64())), "doc_text": held}

    kind = documents.schema[key].dataType.simpleString()
    passed = map_rows(
        documents.select(key, text), hits, f"{key} {kind}, seeds array<bigint>, doc_text string", text
    )
    # Written once: the number of a row stays what it is in every later read.
    passed = cut(passed.withColumn("_place", F.monotonically_increasing_id()))
    candidates = (
        passed.select("_place", F.explode("seeds").alias("seed"))
        .join(listed, "seed")
        .select("_place", "item_id")
        .distinct()
    )
    pairs = candidates.join(items, "item_id").join(passed.select("_place", "doc_text"), "_place")

    def tile(batch):
        covered = []
        for wanted, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = words_of(wanted)
            covered.append(sum(size for _, _, size in tiles(words, words_of(given))) / len(words))
        return {"_place": batch.column(0), "item_id": batch.column(1), "covered": pa.array(covered, pa.float64())}

    tiled = map_rows(
        pairs.select("_place", "item_id", "item_text", "doc_text"),
        tile,
        f"_place bigint, item_id {item_kind}, covered double",
        "doc_text",
    )
    best = tiled.groupBy("_place").agg(
        F.sum((F.col("covered") >= coverage).cast("bigint")).alias("n_items"),
        F.min_by("item_id", F.struct(-F.col("covered"), F.col("item_id"))).alias("item_id"),
        F.max("covered").alias("covered"),
    )
    return passed.select("_place", key).join(best, "_place", "left").select(
        key,
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
        (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
    )

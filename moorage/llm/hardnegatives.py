"""Hard negatives of anchors by exact whole-number inner products, tile by tile."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_rows
from .components import cut

# Whole numbers that a component of one becomes.
SCALE = 256
# Partners of an anchor, and negatives of each of them, that are kept.
POSITIVES, NEGATIVES = 5, 10
# A negative scores from LOW to HIGH hundredths of its positive.
LOW, HIGH = 30, 90
# Rows of a cell of the grid (anchors x candidates), at most on average, and the fewest
# candidates that are worth a cell.
ANCHOR_CELL, CANDIDATE_CELL, LEAST_CELL = 4096, 1 << 16, 4096
# Sides of a tile that is multiplied at once, and of what is multiplied directly.
ANCHOR_TILE, CANDIDATE_TILE, DIRECT = 512, 2048, 32
# Squared lengths below this keep every score times 100 within 64 bits.
_LONGEST = 1 << 55


def _halvings(*sides: int) -> int:
    least, steps = min(sides), 0
    while least > DIRECT:
        least, steps = -(-least // 2), steps + 1
    return steps


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 64-bit whole numbers by seven products of halves, to blocks of DIRECT.

    Sides are padded with zeros so that they halve evenly, and the padding is cut off again.
    Additions of whole numbers are exact; a sum that leaves 64 bits on the way wraps and
    wraps back, so the product is exact if it fits itself.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if not (rows and inner and columns):
        return np.zeros((rows, columns), np.int64)
    unit = 1 << _halvings(rows, inner, columns)
    pad = [-side % unit for side in (rows, inner, columns)]
    if any(pad):
        a = np.pad(a, ((0, pad[0]), (0, pad[1])))
        b = np.pad(b, ((0, pad[1]), (0, pad[2])))
    return _product(a, b, unit)[:rows, :columns]


def _product(a: np.ndarray, b: np.ndarray, unit: int) -> np.ndarray:
    if unit == 1:
        return a @ b
    r, i, c, unit = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2, unit // 2
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    m1 = _product(a11 + a22, b11 + b22, unit)
    m2 = _product(a21 + a22, b11, unit)
    m3 = _product(a11, b12 - b22, unit)
    m4 = _product(a22, b21 - b11, unit)
    m5 = _product(a11 + a12, b22, unit)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, c:] = m3 + m5
    out[r:, :c] = m2 + m4
    out[:r, :c] = m1 + m4 - m5 + _product(a12 - a22, b21 + b22, unit)
    out[r:, c:] = m1 - m2 + m3 + _product(a21 - a11, b11 + b12, unit)
    return out


class Heaps:
    """The ``size`` best (score, key) of every row: higher scores first, then smaller keys.

    An entry that comes twice counts once, so heaps of parts merge into the heap of all.
    """

    def __init__(self, rows: int, size: int):
        self.rows, self.size = rows, size
        self.row = np.zeros(0, np.int64)
        self.score, self.key = self.row, self.row
        # No entry with a lower score can enter any more.
        self.floor = np.full(rows, np.iinfo(np.int64).min)

    def push(self, row: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(row):
            return
        row = np.concatenate([self.row, row])
        score = np.concatenate([self.score, score])
        key = np.concatenate([self.key, key])
        order = np.lexsort((key, -score, row))
        row, score, key = row[order], score[order], key[order]
        new = np.append(True, (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (key[1:] != key[:-1]))
        row, score, key = row[new], score[new], key[new]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        kept = place < self.size
        last = place == self.size - 1
        self.floor[row[last]] = score[last]
        self.row, self.score, self.key = row[kept], score[kept], key[kept]

    def offer(self, scores: np.ndarray, wanted: np.ndarray, keys: np.ndarray, first: int) -> None:
        """Push the wanted scores of a tile whose rows begin at ``first``."""
        wanted = wanted & (scores >= self.floor[first : first + len(scores), None])
        width = scores.shape[1]
        if width > 4 * self.size:
            # A place from the top counts keys that repeat twice: they must not push others out.
            twice = len(np.unique(keys)) < len(keys)
            if not twice:
                at = width - self.size
                low = np.where(wanted, scores, np.iinfo(np.int64).min)
                wanted &= scores >= np.partition(low, at, axis=1)[:, at][:, None]
        row, column = np.nonzero(wanted)
        self.push(row + first, scores[row, column], keys[column])


def _quantised(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, key, label, size, whole): the rows that take part, components as whole numbers."""
    numbers = F.col(vector).cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = usable.select(
        F.monotonically_increasing_id().alias("id"),
        F.col(key).cast("bigint").alias("key"),
        F.col(label).cast("bigint").alias("label"),
        numbers.alias("vector"),
    )

    def run(batch):
        column = batch.column(3)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(column.offsets.to_numpy())
        with np.errstate(over="ignore"):
            flat = np.floor(flat * float(scale))
            row = np.repeat(np.arange(len(sizes)), sizes)
            squares = np.bincount(row, weights=flat * flat, minlength=len(sizes))
        fits = np.flatnonzero(squares < _LONGEST)
        ends = np.append(0, np.cumsum(sizes))
        whole = np.clip(flat, -(1 << 30), 1 << 30).astype("<i4").tobytes()
        take = pa.array(fits)
        return {
            "id": batch.column(0).take(take),
            "key": batch.column(1).take(take),
            "label": batch.column(2).take(take),
            "size": pa.array(sizes[fits], pa.int32()),
            "whole": pa.array([whole[4 * ends[i] : 4 * ends[i + 1]] for i in fits.tolist()], pa.binary()),
        }

    return map_rows(rows, run, "id bigint, key bigint, label bigint, size int, whole binary")


def _grid(anchors: DataFrame, candidates: DataFrame, counts: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_a`` and ``_c``, so that every anchor meets every candidate in one cell.

    Rows are dealt by their number, which no label, key or vector shares, so cells are even
    whatever repeats. A row of one side is repeated for every part of the other: the anchors
    are a stated set, and cells are so large that multiplying takes far longer than moving.
    """
    across = max(1, math.ceil(counts[0] / ANCHOR_CELL))
    cell = min(CANDIDATE_CELL, max(LEAST_CELL, counts[1] // 64))
    down = max(1, math.ceil(counts[1] / cell))

    def dealt(df: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(own_parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)))
        return df.withColumn(own, part).withColumn(other, every)

    return dealt(anchors, "_a", across, "_c", down), dealt(candidates, "_c", down, "_a", across)


def _by_size(anchors: pa.Table, candidates: pa.Table):
    """(anchor rows, their matrix, candidate rows, their matrix) for every size of vector."""

    def matrix(table: pa.Table, rows: np.ndarray, size: int) -> np.ndarray:
        whole = b"".join(table.column("whole").take(pa.array(rows)).to_pylist())
        return np.frombuffer(whole, "<i4").reshape(len(rows), size).astype(np.int64)

    sizes = anchors.column("size").to_numpy(), candidates.column("size").to_numpy()
    for size in np.intersect1d(*sizes).tolist():
        a, c = (np.flatnonzero(s == size) for s in sizes)
        yield a, matrix(anchors, a, size), c, matrix(candidates, c, size)


def _tiles(a: np.ndarray, c: np.ndarray):
    """(first anchor, first candidate, scores) of every tile."""
    turned = np.ascontiguousarray(c.T)
    for i in range(0, len(a), ANCHOR_TILE):
        for j in range(0, len(c), CANDIDATE_TILE):
            yield i, j, strassen(a[i : i + ANCHOR_TILE], turned[:, j : j + CANDIDATE_TILE])


def _best(found: DataFrame, groups: list[str], size: int) -> DataFrame:
    """The heaps of all cells as one: ``rank`` from 1, an entry that several cells have once."""
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), "key")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= size)
    return ranked.dropDuplicates([*groups, "rank"])


def _positives(anchors: DataFrame, candidates: DataFrame, counts: tuple[int, int], size: int) -> DataFrame:
    """(id, rank, key, score): the best other rows of each anchor's label."""
    left, right = _grid(anchors, candidates, counts)

    def cell(a: pa.Table, c: pa.Table) -> pa.Table:
        ids, heaps = a.column("id").to_numpy(), []
        for rows, own, columns, others in _by_size(a, c):
            labels, theirs = a.column("label").to_numpy()[rows], c.column("label").to_numpy()[columns]
            keys, their_keys = a.column("key").to_numpy()[rows], c.column("key").to_numpy()[columns]
            for label in np.intersect1d(labels, theirs).tolist():
                mine, same = np.flatnonzero(labels == label), np.flatnonzero(theirs == label)
                heap = Heaps(len(mine), size)
                for i, j, scores in _tiles(own[mine], others[same]):
                    near = their_keys[same[j : j + CANDIDATE_TILE]]
                    other = keys[mine[i : i + ANCHOR_TILE], None] != near[None, :]
                    heap.offer(scores, other, near, i)
                heaps.append((ids[rows[mine[heap.row]]], heap.key, heap.score))
        return _table(heaps, ("id", "key", "score"))

    found = (
        left.groupBy("_a", "_c").cogroup(right.groupBy("_a", "_c")).applyInArrow(cell, "id bigint, key bigint, score bigint")
    )
    return _best(found, ["id"], size)


def _table(parts: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*parts) if parts else [()] * len(names)
    none = np.zeros(0, np.int64)
    return pa.table({name: np.concatenate([none, *column]).astype(np.int64) for name, column in zip(names, columns)})


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    *,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a row's score is its inner product with the anchor.
    An anchor's positives are its first ``positives`` other rows of its label; for each, the
    first ``negatives`` rows of other labels with low * positive <= 100 * negative <=
    high * positive are returned. Higher scores come first, then smaller keys.

    ``anchors`` has the columns of ``vectors``; keys and labels are whole numbers. Rows with a
    NULL key or label, a NULL vector, or a NULL or non-finite component take no part, nor do
    rows whose whole components have a squared length of 2**55 or more, whose scores could
    leave 64 bits. Vectors of unlike size do not meet; those of no component score 0. "Other"
    means another key: of repeated rows one partner counts, and a repeated anchor is one
    anchor. A positive without negatives gives no rows, nor does an empty table. Further
    columns are left out.

    1. Anchors and candidates are dealt to a grid of bounded cells; in a cell, tiles are
       multiplied by Strassen's recursion and heaps keep the best partners of each anchor.
    2. The heaps of all cells merge into the positives, which set the windows.
    3. The grid is passed again with a heap for each window; these merge in the same way.
    """
    rows = cut(_quantised(vectors, key, vector, label, scale))
    stated = cut(_quantised(anchors, key, vector, label, scale).dropDuplicates(["key", "label", "whole"]))
    counts = stated.count(), rows.count()
    found = cut(_positives(stated, rows, counts, positives))
    windows = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("positives"))
    left, right = _grid(stated.join(windows, "id"), rows, counts)

    def cell(a: pa.Table, c: pa.Table) -> pa.Table:
        ids, out = a.column("id").to_numpy(), []
        lists = a.column("positives").to_pylist()
        for rows_, own, columns, others in _by_size(a, c):
            labels, theirs = a.column("label").to_numpy()[rows_], c.column("label").to_numpy()[columns]
            their_keys = c.column("key").to_numpy()[columns]
            mine = [lists[row] for row in rows_.tolist()]
            slots = max(map(len, mine))
            # A window without a positive is empty: its top is below its bottom.
            tops = np.full((slots, len(mine)), -1, np.int64)
            bottoms = np.zeros((slots, len(mine)), np.int64)
            for row, found_ in enumerate(mine):
                for slot, one in enumerate(found_):
                    tops[slot, row] = high * one["score"] // 100
                    bottoms[slot, row] = -(-low * one["score"] // 100)
            heaps = [Heaps(len(mine), negatives) for _ in range(slots)]
            for i, j, scores in _tiles(own, others):
                keys = their_keys[j : j + CANDIDATE_TILE]
                strip = slice(i, i + ANCHOR_TILE)
                other = labels[strip, None] != theirs[None, j : j + CANDIDATE_TILE]
                for slot, heap in enumerate(heaps):
                    inside = (scores <= tops[slot, strip, None]) & (scores >= bottoms[slot, strip, None])
                    heap.offer(scores, other & inside, keys, i)
            for slot, heap in enumerate(heaps):
                out.append((ids[rows_[heap.row]], np.full(len(heap.row), slot + 1), heap.key, heap.score))
        return _table(out, ("id", "place", "key", "score"))

    schema = "id bigint, place bigint, key bigint, score bigint"
    heaps = left.groupBy("_a", "_c").cogroup(right.groupBy("_a", "_c")).applyInArrow(cell, schema)
    best = _best(heaps, ["id", "place"], negatives)
    named = found.select(
        "id", F.col("rank").cast("bigint").alias("place"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(stated.select("id", F.col("key").alias("anchor_id")), "id")
    return best.join(named, ["id", "place"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("key").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

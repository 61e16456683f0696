"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_group, group_bounds, map_rows
from .components import connected_components, cut, paired_blocks
from .simhash import local_roots

# Width of a quantised projection of unit vectors.
WIDTH = 1.5
# Chance, at the very threshold, that a pair shares no bucket in any table.
MISS = 5e-4
# Unrelated vectors that a bucket may hold on average.
STRAY = 32
BLOCK = 1024
_PAIRS_AT_ONCE = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors this far apart fall into one slot of a projection."""
    if distance <= 0:
        return 1.0
    ratio = width / distance
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def table_shape(vectors: int, cosine: float) -> tuple[int, int]:
    """Projections per table, so that stray neighbours stay few, and tables, so that a pair
    at the threshold is missed with chance MISS at most."""
    near = collision(math.sqrt(2 - 2 * cosine))
    far = collision(math.sqrt(2))
    projections = max(1, math.ceil(math.log(max(vectors, STRAY + 1) / STRAY) / -math.log(far)))
    tables = math.ceil(math.log(MISS) / math.log1p(-(near**projections)))
    return projections, tables


class Buckets:
    """Bucket numbers of unit vectors in every table; the same on every executor."""

    def __init__(self, projections: int, tables: int, seed: int = 11):
        self.projections, self.tables, self.seed = projections, tables, seed
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, units: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """One 64-bit bucket number per vector and table; label and size are part of it."""
        size = units.shape[1]
        if size not in self.by_size:
            random = np.random.default_rng([self.seed, size])
            lines = random.standard_normal((size, self.projections * self.tables))
            self.by_size[size] = lines, random.uniform(0, WIDTH, self.projections * self.tables)
        lines, shifts = self.by_size[size]
        slots = np.floor((units @ lines + shifts) / WIDTH).astype(np.int64).view(np.uint64)
        slots = slots.reshape(len(units), self.tables, self.projections)
        out = np.full((len(units), self.tables), np.uint64(size), np.uint64)
        out ^= labels.astype(np.int64).view(np.uint64)[:, None] << np.uint64(20)
        out += np.arange(self.tables, dtype=np.uint64)[None, :] << np.uint64(8)
        for step in range(self.projections):
            out = (out ^ (out >> np.uint64(29))) * _MIX + slots[:, :, step]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return (out ^ (out >> np.uint64(29))).view(np.int64)


def _by_size(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors, in double precision, for each vector size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    out = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        vectors = flat[starts[rows][:, None] + np.arange(size)]
        # A large or tiny length must not overflow: scale by the largest component first.
        vectors /= np.abs(vectors).max(axis=1, keepdims=True)
        out.append((rows, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)))
    return out


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.93,
) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors of one label link from ``cosine`` on: n_links counts the others linked directly,
    component_id is the smallest key reachable, kept says that it is the row's own. Equal
    vectors of a label are compared once and count as often as they occur. Rows whose vector
    is NULL, empty, zero or holds a NULL or non-finite component, or whose label is NULL,
    link with nothing, and vectors of unlike size never link. A NULL key is its own
    component if alone. Further columns are left out; an empty table gives no rows.

    Every vector goes to one bucket of each table. Within a bucket cosines are exact; a
    pair counts in the first table that it meets in, and only row counts and links to
    the smallest member of each local component leave a bucket, never all pairs.
    """
    # Adding 0.0 makes minus zero equal to zero.
    numbers = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        numbers, lambda x: x != 0
    )
    usable = F.coalesce(fine & F.col(label).isNotNull(), F.lit(False))
    rows = vectors.select(
        F.col(key).alias("_key"),
        F.when(usable, F.xxhash64(F.col(label), numbers)).alias("_hash"),
        F.when(usable, F.xxhash64(F.lit(1), F.col(label), numbers)).alias("_twin"),
        F.xxhash64(F.col(label)).alias("_label"),
        F.when(usable, numbers).alias("_vector"),
    )
    classes = cut(
        rows.where(F.col("_hash").isNotNull())
        .groupBy("_hash", "_twin")
        .agg(
            F.min("_key").alias("first"),
            F.count(F.lit(1)).alias("size"),
            F.first("_label").alias("_label"),
            F.first("_vector").alias("_vector"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    projections, tables = table_shape(classes.count(), cosine)
    buckets = Buckets(projections, tables)

    def scatter(batch):
        labels = batch.column(2).to_numpy()
        picked, places, numbers_of = [], [], []
        for found, units in _by_size(batch.column(3)):
            numbers_of.append(buckets.of(units, labels[found]).T.reshape(-1))
            picked.append(np.tile(found, tables))
            places.append(np.repeat(np.arange(tables), len(found)))
        take = pa.array(np.concatenate(picked))
        return {
            "bucket": pa.array(np.concatenate(numbers_of), pa.int64()),
            "place": pa.array(np.concatenate(places).astype(np.int32), pa.int32()),
            "id": batch.column(0).take(take),
            "size": batch.column(1).take(take),
            "_label": batch.column(2).take(take),
            "_vector": batch.column(3).take(take),
        }

    spread = map_rows(
        classes.select("id", "size", "_label", "_vector"),
        scatter,
        "bucket bigint, place int, id bigint, size bigint, _label bigint, _vector array<double>",
    )
    blocks = paired_blocks(spread, ["bucket"], F.col("id"), BLOCK)

    def compare(table: pa.Table) -> pa.Table:
        bounds = group_bounds(table, ["bucket", "_lo", "_hi"])
        ids = table.column("id").to_numpy()
        sizes = table.column("size").to_numpy()
        labels = table.column("_label").to_numpy()
        places = table.column("place").to_numpy()
        sides = table.column("_side").to_numpy()
        paired = table.column("_lo").to_numpy() != table.column("_hi").to_numpy()
        outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        units_of = _by_size(table.column("_vector"))
        where = np.zeros(table.num_rows, np.int64)
        kind = np.zeros(table.num_rows, np.int64)
        for number, (found, _) in enumerate(units_of):
            where[found], kind[found] = np.arange(len(found)), number
        long = np.flatnonzero(np.diff(bounds) > 1)
        for start, end in zip(bounds[long].tolist(), bounds[long + 1].tolist()):
            if (kind[start:end] != kind[start]).any():
                continue  # the size is part of the bucket number: only by a collision
            units = units_of[kind[start]][1][where[start:end]]
            cosines = units @ units.T
            near = np.triu(cosines >= cosine, 1)
            if paired[start]:
                near &= sides[start:end][:, None] != sides[start:end][None, :]
            near &= labels[start:end][:, None] == labels[start:end][None, :]
            left, right = np.nonzero(near)
            if not len(left):
                continue
            linked = np.unique(np.concatenate([left, right]))
            signs = np.zeros((end - start, tables), np.int64)
            signs[linked] = buckets.of(units[linked], labels[start:end][linked])
            counts = np.zeros(end - start, np.int64)
            own = sizes[start:end]
            for at in range(0, len(left), _PAIRS_AT_ONCE):
                i, j = left[at : at + _PAIRS_AT_ONCE], right[at : at + _PAIRS_AT_ONCE]
                new = (signs[i] == signs[j]).argmax(axis=1) == places[start]
                np.add.at(counts, i[new], own[j[new]])
                np.add.at(counts, j[new], own[i[new]])
            order = np.argsort(ids[start:end])
            rank = np.empty(end - start, np.int64)
            rank[order] = np.arange(end - start)
            root = local_roots(end - start, rank[left], rank[right])
            outs.append((ids[start:end][linked], ids[start:end][order[root[rank[linked]]]], counts[linked]))
        empty = np.zeros(0, np.int64)
        columns = [np.concatenate([empty, *part]) for part in (zip(*outs) if outs else ((), (), ()))]
        return pa.table(dict(zip(("a", "b", "links"), columns)))

    found = cut(by_group(blocks, ["bucket", "_lo", "_hi"], compare, "a bigint, b bigint, links bigint"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    roots = connected_components(found.select("a", "b")).withColumnRenamed("node", "id")
    rooted = cut(
        classes.select("id", "_hash", "_twin", "first", "size")
        .join(roots, "id", "left")
        .join(links, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    result = cut(
        rooted.join(least, "root").select(
            "_hash",
            "_twin",
            "component_id",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    final = rows.select("_key", "_hash", "_twin").join(result, ["_hash", "_twin"], "left")
    component = F.coalesce("component_id", "_key")
    return final.select(
        F.col("_key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.col("_key").isNull()).alias("kept"),
    )

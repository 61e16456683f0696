"""SimHash near-duplicates through vantage-point shards of the fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_group, group_bounds, map_rows
from .components import connected_components, cut, paired_blocks

WORDS = 3
SEED = 42
RADIUS = 2
# Fingerprints that a task compares with each other.
BLOCK = 2048
# Fingerprints of the sample that vantage points and radii are chosen from, at most.
SAMPLE = 1 << 17
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    """64 bits: a bit is set if over half the shingles' XXH64 values have it.

    A-Z are lower-cased, words are what stands between ASCII white space, shingles are
    ``WORDS`` words joined by spaces, repeats included. Fewer words: one shingle. None: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - WORDS + 1].tolist()
    stops = ends[WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = slice(at, at + _SHINGLES_AT_ONCE)
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[part], stops[part])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed number; NULL texts count as empty."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batch):
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        found = np.array([fingerprint(t or b"") for t in texts], np.uint64)
        return {key: batch.column(0), "fp": pa.array(found.view(np.int64), pa.int64())}

    return map_rows(documents.select(key, text), run, f"{key} {kind}, fp bigint", text)


class VantageTree:
    """Shards of Hamming space: node n's points within its radius go to child 2n."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 0):
        self.depth = depth
        self.points = np.zeros(1 << depth, np.uint64)
        self.radii = np.full(1 << depth, 64, np.int64)
        random = np.random.default_rng(seed)
        parts = {1: np.unique(sample)}
        for node in range(1, 1 << depth):
            part = parts.pop(node, np.zeros(0, np.uint64))
            if len(part) < 8:
                continue
            best = None
            for point in random.choice(part, min(8, len(part)), replace=False):
                counts = np.bincount(np.bitwise_count(part ^ point), minlength=65 + RADIUS)
                inside = np.cumsum(counts)[:65] / len(part)
                # Points just beyond the radius are sent to both sides: as few as can be.
                shared = np.array([counts[r + 1 : r + 1 + RADIUS].sum() for r in range(65)]) / len(part)
                cost = shared + np.abs(inside - 0.5) + (np.minimum(inside, 1 - inside) < 0.2)
                radius = int(cost.argmin())
                if best is None or cost[radius] < best[0]:
                    best = (cost[radius], point, radius)
            self.points[node], self.radii[node] = best[1], best[2]
            near = np.bitwise_count(part ^ best[1]) <= best[2]
            parts[2 * node], parts[2 * node + 1] = part[near], part[~near]

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a value stands in or whose boundary it overlaps.

        By the triangle inequality a partner within RADIUS of a point outside is inside
        only if that point is within radius + RADIUS: such points are sent inside as well.
        """
        rows, nodes = np.arange(len(values)), np.ones(len(values), np.int64)
        for _ in range(self.depth):
            apart = np.bitwise_count(values[rows] ^ self.points[nodes]).astype(np.int64)
            radius = self.radii[nodes]
            outside = apart > radius
            overlap = outside & (apart <= radius + RADIUS)
            rows = np.concatenate([rows, rows[overlap]])
            nodes = np.concatenate([2 * nodes + outside, 2 * nodes[overlap]])
        return rows, nodes


def local_roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For 0..count-1 the smallest index linked to it, directly or not."""
    root = np.arange(count)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new
    return root


def _links_of(values: np.ndarray, sides: np.ndarray, paired: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (left, right) within RADIUS, a strip of rows at a time."""
    lefts, rights = [], []
    a = np.flatnonzero(sides == 0) if paired else np.arange(len(values))
    b = np.flatnonzero(sides == 1) if paired else a
    strip = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), strip):
        rows = a[at : at + strip]
        near = np.bitwise_count(values[rows][:, None] ^ values[b][None, :]) <= RADIUS
        i, j = np.nonzero(near)
        lefts.append(rows[i])
        rights.append(b[j])
    left, right = np.concatenate(lefts or [a[:0]]), np.concatenate(rights or [a[:0]])
    apart = left < right if not paired else left != right
    return left[apart], right[apart]


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints within RADIUS into the right components.

    ``distinct`` has one column fp without repeats. Within a shard only the links to the
    smallest member of each local component are returned, not all pairs.
    """
    total = distinct.count()
    depth = max(0, min(math.ceil(math.log2(max(1, total) / (BLOCK // 2))), int(math.log2(SAMPLE)) - 5))
    wanted = 1 << (depth + 5)
    share = min(1.0, wanted / max(1, total))
    some = distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))
    sample = np.array([r[0] for r in some.collect()], np.int64).view(np.uint64)
    tree = VantageTree(np.sort(sample), depth)

    def place(batch):
        values = batch.column(0).to_numpy()
        rows, leaves = tree.shards(values.view(np.uint64))
        return {"leaf": pa.array(leaves, pa.int64()), "fp": pa.array(values[rows], pa.int64())}

    sharded = map_rows(distinct, place, "leaf bigint, fp bigint")
    blocks = paired_blocks(sharded, ["leaf"], F.col("fp"), BLOCK)

    def link(table: pa.Table) -> pa.Table:
        bounds = group_bounds(table, ["leaf", "_lo", "_hi"])
        signed = table.column("fp").to_numpy()
        sides = table.column("_side").to_numpy()
        paired = table.column("_lo").to_numpy() != table.column("_hi").to_numpy()
        ends_a, ends_b = [], []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start < 2:
                continue
            part = signed[start:end]
            order = np.argsort(part)
            part = part[order]
            left, right = _links_of(part.view(np.uint64), sides[start:end][order], bool(paired[start]))
            root = local_roots(len(part), left, right)
            moved = np.flatnonzero(root != np.arange(len(part)))
            ends_a.append(part[moved])
            ends_b.append(part[root[moved]])
        empty = np.zeros(0, np.int64)
        return pa.table(
            {"a": np.concatenate([empty, *ends_a]), "b": np.concatenate([empty, *ends_b])},
            schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]),
        )

    return by_group(blocks, ["leaf", "_lo", "_hi"], link, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, fingerprint, component_id), one row per document row.

    Documents whose fingerprints differ in at most RADIUS bits are linked; component_id is
    the smallest key reachable. Equal fingerprints are compared once. NULL and empty texts
    share the fingerprint zero; a NULL key is never a component_id unless its component has
    no other. Repeated rows stay; further columns are left out; an empty table gives none.
    """
    found = cut(fingerprints(documents, key, text))
    distinct = cut(found.groupBy("fp").agg(F.min(key).alias("first")))
    roots = connected_components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted)
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    by_fp = cut(rooted.join(least, "root").select("fp", "component_id"))
    return found.join(by_fp, "fp").select(
        key, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

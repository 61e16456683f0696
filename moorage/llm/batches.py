"""Small helpers to run numpy code over Arrow batches of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that one Python worker looks at together: by count and by bytes of text.
SLICE_ROWS = 2048
SLICE_BYTES = 4 << 20


def slices(
    batch: pa.RecordBatch, text: str | None = None, size_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and, past the first row, of bytes."""
    if text is None:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and (held + size > size_bytes or row - start >= SLICE_ROWS):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column, NULL as the empty text."""
    return [value or "" for value in column.to_pylist()]


# Columns that stand for the text of a row.
DIGEST = ["_text", "_twin"]


def with_digest(documents: DataFrame, text: str = "text") -> DataFrame:
    """Two hashes that stand for the text of a row, NULL as the empty text."""
    value = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumns({"_text": F.xxhash64(value), "_twin": F.xxhash64(F.lit(1), value)})


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other as bytes, and where each begins (one entry more)."""
    blobs = [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    starts = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(b"".join(blobs), np.uint8), starts


def map_rows(
    df: DataFrame, function: Callable, schema: str, text: str | None = None, size_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``function`` takes a bounded record batch and returns a dict of columns or a batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, size_bytes):
                out = function(part)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_pydict(out)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def whole_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; a group may span batches.

    Holds at most one batch and the group that is still open, so groups must be bounded.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
            if held and held[-1].column(key)[-1].as_py() != values[0]:
                changes[0] = True
        at = np.flatnonzero(changes)
        if not held:
            at = at[at > 0]
        if not len(at):
            held.append(batch)
            continue
        last = int(at[-1])
        done = [*held, batch.slice(0, last)] if last else held
        yield pa.Table.from_batches([b for b in done if b.num_rows]).combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_group(df: DataFrame, keys: list[str], function: Callable, schema: str, order: str | None = None) -> DataFrame:
    """Shuffle by ``keys`` and run ``function`` on tables that hold whole groups.

    Many small groups come in one table, so the cost per group stays low.
    """

    def run(batches):
        for table in whole_groups(batches, keys):
            yield from function(table).to_batches()

    dealt = df.repartition(*[F.col(k) for k in keys])
    return dealt.sortWithinPartitions(*keys, *([order] if order else [])).mapInArrow(run, schema)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of a sorted table begins, and its row count at the end."""
    n = table.num_rows
    changes = np.zeros(n, bool)
    if n:
        changes[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        changes[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changes), n)

"""Grouping, numbering and lookups that stay even when one group holds much of the table.

All of them rest on one bound: of N rows, at most N / limit groups can have more
than ``limit`` rows. Those heavy groups are found with a map-side combined count
over the key columns only, once per call. If there are none, the plain Spark route is
taken; else the heavy groups are worked on apart. The result is the same either way.
Joins with the list of heavy groups carry no hint: Spark goes by its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

GROUP_ROWS = 1_000_000
# Rows that one task numbers without being split, whatever limit a caller gives.
SLICE_ROWS = 100_000


def _require_whole_numbers(df: DataFrame, order: str) -> None:
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        raise ValueError(f"{order} must be a whole number column giving the listing position")


def heavy_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Key values with more than ``limit`` rows, as ``_heavy_<key>`` columns and ``_heavy_rows``."""
    return (
        df.groupBy(*[F.col(k).alias(f"_heavy_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_heavy_rows"))
        .where(F.col("_heavy_rows") > limit)
    )


def _is_heavy(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_heavy_{k}")) for k in keys])


def sliced(
    heavy_rows: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int
) -> DataFrame:
    """Add ``slice``: ranges of (keys, order) over all rows, cut by Spark's own sampling.

    A slice has about rows / slices rows, however sparse or wide the positions are; only
    rows that agree in every column of ``order`` cannot be told apart. The rows are
    written once, so that every later read sees the same slices.
    """
    dealt = heavy_rows.repartitionByRange(slices, *keys, *order)
    return written(dealt.withColumn("slice", F.spark_partition_id().cast("bigint")), "slices")


def _plainly(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    return df.withColumns(
        {
            "pos": F.row_number().over(group.orderBy(*order)).cast("bigint"),
            "n": F.count(F.lit(1)).over(group),
        }
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    limit: int = GROUP_ROWS,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Add ``pos`` (1-based position in the group by ``order``) and ``n`` (group size).

    Without heavy groups rows shuffle once, on the keys. The rows of heavy groups are cut
    into slices of their order, numbered slice by slice and shifted by the rows in earlier
    slices of the same group. ``order`` may name more columns to break ties. NULL is a key
    like any other.

    The columns of ``per_group``, which has one row per group, come along (NULL for a group
    it does not have).
    """
    if isinstance(order, str):
        _require_whole_numbers(df, order)
        order = [order]
    heavy = heavy_groups(df.select(*keys), keys, limit)
    total = heavy.agg(F.sum("_heavy_rows")).first()[0]

    def along(rows: DataFrame) -> DataFrame:
        return rows if per_group is None else rows.join(per_group, [*keys], "left")

    size = max(limit, SLICE_ROWS)
    # Heavy groups that fit one slice together need no slicing.
    if (total or 0) <= size:
        return along(_plainly(df, keys, order))
    heavy = written(heavy, "heavy")
    light = _plainly(df.join(heavy, _is_heavy(keys), "left_anti"), keys, order)
    rows = sliced(df.join(heavy, _is_heavy(keys), "left_semi"), keys, order, -(-total // size))
    # A group has at most as many slices as there are: these windows see counts only.
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy(*keys, "slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *[F.col(k).alias(f"_heavy_{k}") for k in keys],
            F.col("slice").alias("_slice"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(group).alias("n"),
        )
    )
    within = Window.partitionBy(*keys, "slice").orderBy(*order)
    shifted = (
        rows.withColumn("_local", F.row_number().over(within).cast("bigint"))
        .join(shifts, _is_heavy(keys) & (F.col("slice") == F.col("_slice")))
        .withColumn("pos", F.col("_local") + F.col("_before"))
        .select(*df.columns, "pos", "n")
    )
    return along(light).unionByName(along(shifted))


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    limit: int = GROUP_ROWS,
    counted: DataFrame | None = None,
    how: str = "left",
) -> DataFrame:
    """Join to ``right``, which has few rows per key, even where one key fills ``left``.

    The left rows of a heavy key are dealt out by the hash of the ``spread`` columns
    (something that differs from row to row) over rows / limit salts, and that key's
    right rows are repeated once per salt: at most N / limit extra rows for one row a key.
    A NULL key matches nothing but is spread all the same. ``counted`` is the table
    to find the heavy keys in, when ``left`` was derived from it at some cost.
    """
    heavy = heavy_groups(
        (left if counted is None else counted).select(*keys), keys, limit
    )
    if heavy.isEmpty():
        return left.join(right, [*keys], how)
    salts = F.ceil(F.col("_heavy_rows") / F.lit(limit)).cast("bigint")
    heavy = written(heavy.withColumn("_salts", salts).drop("_heavy_rows"), "heavy")
    heavy_columns = [f"_heavy_{k}" for k in keys] + ["_salts"]
    one = F.lit(1).cast("bigint")
    salt = F.pmod(F.xxhash64(*spread), F.coalesce(F.col("_salts"), one))
    salted_left = (
        left.join(heavy, _is_heavy(keys), "left").withColumn("_salt", salt).drop(*heavy_columns)
    )
    every_salt = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), one) - one)
    salted_right = (
        right.join(heavy, _is_heavy(keys), "left")
        .withColumn("_salt", F.explode(every_salt))
        .drop(*heavy_columns)
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def first_by(df: DataFrame, keys: Sequence[str], order: str, *columns: str) -> DataFrame:
    """The first listed row per key; combined map-side, so a hot key costs nothing."""
    kept = F.struct(*[F.col(c) for c in columns])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(kept, F.col(order)).alias("_first"))
        .select(*keys, *[F.col("_first")[c].alias(c) for c in columns])
    )


def gathered(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """(keys..., column): the values of each group as an array, in order.

    For groups of bounded size, such as slices. Gathering combines nothing map-side, so
    the rows shuffle as they are instead of as half-built arrays.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(column))))
    return (
        df.select(*keys, order, column)
        .repartition(*keys)
        .groupBy(*keys)
        .agg(F.transform(pairs, lambda pair: pair[column]).alias(column))
    )

"""Since when clusters are ready, by a sweep over what their members' probes told."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a probe event says of a member.
ANSWERS, SILENT, GONE = "answers", "silent", "gone"


def _running(df: DataFrame, keys: Sequence[str], at: str, slot: str, sums: dict[str, str]) -> DataFrame:
    """Add running sums by ``at`` within ``keys``: column to the name of its sum.

    Slots are summed up first, which combines map-side; a row then adds the sum of the earlier
    slots to the running sum in its own slot. So no task sorts more than one slot of a group.
    ``slot`` must not fall while ``at`` rises.
    """
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, slot).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = totals.select(
        *keys, slot, *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    within = Window.partitionBy(*keys, slot).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(before, [*keys, slot])
    return joined.withColumns({name: F.col(f"_{c}") + F.sum(c).over(within) for c, name in sums.items()}).drop(
        *[f"_{c}" for c in sums]
    )


def _previous(df: DataFrame, keys: Sequence[str], at: str, slot: str, column: str) -> DataFrame:
    """Add ``_before``: the value of ``column`` in the row before by ``at`` within ``keys``, slot by slot."""
    last = df.groupBy(*keys, slot).agg(F.max_by(column, at).alias("_last"))
    group = Window.partitionBy(*keys).orderBy(slot)
    carried = last.select(*keys, slot, F.lag("_last").over(group).alias("_carried"))
    within = Window.partitionBy(*keys, slot).orderBy(at)
    return df.join(carried, [*keys, slot]).withColumn(
        "_before", F.coalesce(F.lag(column).over(within), F.col("_carried"))
    ).drop("_carried")


def ready_since(
    events: DataFrame,
    *,
    cluster: str = "cluster_id",
    member: str = "member",
    at: str = "at",
    order: str = "ord",
    state: str = "state",
    slot: Callable[[Column], Column] = F.to_date,
) -> DataFrame:
    """(cluster, n_members, n_silent, ready, first_ready, ready_since), one row per cluster.

    An event says that from a moment on a member ``answers``, is ``silent`` or is ``gone``; a member
    belongs to its cluster from its first event until it is gone, and may come back. A cluster
    is ready while it has members and all of them answer. ``first_ready`` is the first such
    moment, ``ready_since`` the beginning of the stretch that lasts to this day, both NULL if
    there is none; the counts and ``ready`` are those after the last event.

    What happens at one moment is judged when all of it has happened. Of a member's events at
    one moment the last by ``order`` counts; an event that repeats the state changes nothing.
    Events with another state, or a NULL in cluster, member or time, are left out.

    Every event becomes a change of two counts, members and silent members; their running sums
    over the moments of a cluster tell when it is ready. Nothing waits, and nothing is gathered
    per cluster: sums go slot by slot (a day each, or as ``slot`` cuts the time), so the events
    of a busy cluster or member are spread over tasks.
    """
    known = events.where(
        F.col(state).isin(ANSWERS, SILENT, GONE)
        & F.col(cluster).isNotNull() & F.col(member).isNotNull() & F.col(at).isNotNull()
    ).select(
        F.col(cluster).alias("_cluster"), F.col(member).alias("_member"), F.col(at).alias("_at"),
        F.col(order).alias("_order"), F.col(state).alias("_state"),
    )
    moments = known.groupBy("_cluster", "_member", "_at").agg(
        F.max_by("_state", F.struct("_order", "_state")).alias("_state")
    )
    moments = moments.withColumn("_slot", slot(F.col("_at")))
    changes = _previous(moments, ["_cluster", "_member"], "_at", "_slot", "_state")

    def present(value: str) -> Column:
        return F.coalesce(F.col(value) != GONE, F.lit(False)).cast("bigint")

    def silent(value: str) -> Column:
        return F.coalesce(F.col(value) == SILENT, F.lit(False)).cast("bigint")

    deltas = changes.groupBy("_cluster", "_slot", "_at").agg(
        F.sum(present("_state") - present("_before")).alias("_members"),
        F.sum(silent("_state") - silent("_before")).alias("_silents"),
    )
    swept = _running(deltas, ["_cluster"], "_at", "_slot", {"_members": "n_members", "_silents": "n_silent"})
    judged = swept.select(
        "_cluster", "_at", "n_members", "n_silent",
        ((F.col("n_members") > 0) & (F.col("n_silent") == 0)).alias("ready"),
    )
    # The last stretch begins at the first ready moment behind the last one that is not.
    unready = F.max(F.when(~F.col("ready"), F.col("_at"))).alias("_unready")
    ends = judged.groupBy("_cluster").agg(
        F.max_by(F.struct("n_members", "n_silent", "ready"), "_at").alias("_now"),
        F.min(F.when(F.col("ready"), F.col("_at"))).alias("first_ready"),
        unready,
    )
    stretch = (
        judged.join(ends.select("_cluster", "_unready"), "_cluster")
        .where(F.col("_unready").isNull() | (F.col("_at") > F.col("_unready")))
        .groupBy("_cluster")
        .agg(F.min("_at").alias("ready_since"))
    )
    return ends.join(stretch, "_cluster", "left").select(
        F.col("_cluster").alias(cluster), "_now.n_members", "_now.n_silent", "_now.ready", "first_ready", "ready_since"
    )

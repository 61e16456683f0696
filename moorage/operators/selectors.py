"""Many label selectors against all labelled machines at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .groups import GROUP_ROWS, lookup, numbered
from .inventory import OWNER_LABEL

# Ids that one block holds, and pairs of ids that one task looks at.
_BLOCK_IDS = 512
_TASK_PAIRS = 8_000_000
_MOST_TASKS = 20_000
_PAIR = ["_key", "_value"]


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """(_pairs, _ids, _size): rows (_id, _pairs) with equal pairs together, ``_BLOCK_IDS`` at most."""
    block = F.expr(f"(pos - 1) div {_BLOCK_IDS}")
    placed = numbered(rows, ["_pairs"], ["_id"], limit).withColumn("_block", block)
    # NULL is an id like any other, but no list would collect it bare.
    ids = F.transform(F.collect_list(F.struct("_id")), lambda x: x["_id"])
    return (
        placed.groupBy("_pairs", "_block")
        .agg(ids.alias("_ids"), F.count(F.lit(1)).alias("_size"))
        .drop("_block")
    )


def _sorted_pairs(pairs: Column) -> Column:
    pair = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("_key"), e["value"].alias("_value")))
    return F.sort_array(pair)


def match_selectors(
    machines: DataFrame,
    selectors: DataFrame,
    *,
    machine_id: str = "machine_id",
    labels: str = "labels",
    selector_id: str = "selector_id",
    wanted: str = "wanted",
    owner: str | None = None,
    owner_label: str = OWNER_LABEL,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(selector_id, machine_id): the machines whose labels hold every pair of a selector.

    ``wanted`` is a selector's map of labels; the column ``owner``, if named and not NULL, adds
    the owner pair and overrides a pair of that label. A pair with a NULL value matches
    nothing. A selector without any pair, which would stand for the whole fleet, has no rows.
    ``selector_id`` is unique; machines that repeat match as often.

    Selectors that want the same meet as one, and so do machines with equal labels, in blocks of
    ids that only the result takes apart again. The machines' pairs are an inverted index. A
    selector is looked up by one pair only, the one that the fewest machines have, and its other
    pairs are checked on the machines found there, so no selector meets a machine that lacks its
    rarest pair. A pair is dealt out over as many tasks as its machines and selectors make
    pairs of ids.
    """
    pairs = F.col(wanted)
    if owner is not None:
        others = F.map_filter(F.coalesce(pairs, F.create_map().cast("map<string,string>")), lambda k, _: k != owner_label)
        with_owner = F.map_concat(others, F.create_map(F.lit(owner_label), F.col(owner)))
        pairs = F.when(F.col(owner).isNull(), pairs).otherwise(with_owner)
    wishes = selectors.select(F.col(selector_id).alias("_id"), _sorted_pairs(pairs).alias("_pairs"))
    wishes = wishes.where((F.size("_pairs") > 0) & ~F.exists("_pairs", lambda p: p["_value"].isNull()))
    fleet = machines.select(F.col(machine_id).alias("_id"), _sorted_pairs(F.col(labels)).alias("_pairs"))
    fleet = written(_blocks(fleet.where(F.size("_pairs") > 0), limit), "machine-blocks")
    held = fleet.select(
        F.col("_pairs").alias("_labels"), F.col("_ids").alias("_machines"),
        F.col("_size").alias("_held"), F.explode("_pairs").alias("_pair"),
    ).select("_labels", "_machines", "_held", "_pair.*").where(F.col("_value").isNotNull())
    spread = held.groupBy(*_PAIR).agg(F.sum("_held").alias("_spread"), F.count(F.lit(1)).alias("_held_blocks"))

    asked = wishes.select("_pairs").distinct().select("_pairs", F.explode("_pairs").alias("_pair")).select("_pairs", "_pair.*")
    least = F.min(F.struct("_spread", *_PAIR)).alias("_rarest")
    rarest = (
        lookup(asked, spread.select(*_PAIR, "_spread"), _PAIR, ["_pairs"], limit, how="inner")
        .groupBy("_pairs")
        .agg(F.count(F.lit(1)).alias("_known"), least)
        # A pair that no machine has, the whole selector has none.
        .where(F.col("_known") == F.size("_pairs"))
        .select("_pairs", "_rarest._key", "_rarest._value")
    )
    index = written(_blocks(wishes, limit).join(rarest, "_pairs"), "selector-blocks")
    # What a pair makes: its machines times its selectors. Cut so that a task has a bounded share.
    made = index.groupBy(*_PAIR).agg(F.sum("_size").alias("_asked")).join(spread, _PAIR)
    work = F.col("_asked") * F.col("_spread")
    shares = F.greatest(F.lit(1), F.least(F.col("_held_blocks"), F.ceil(work / F.lit(_TASK_PAIRS))))
    dealt = written(made.select(*_PAIR, work.alias("_work"), shares.cast("bigint").alias("_shares")), "pair-shares")
    total = dealt.agg(F.sum("_work")).first()[0] or 0
    tasks = int(min(max(total // _TASK_PAIRS, 1), _MOST_TASKS))

    share = F.pmod(F.xxhash64("_labels", "_machines"), F.col("_shares"))
    every_share = F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)
    shared = dealt.drop("_work")
    left = lookup(held, shared, _PAIR, ["_labels"], limit, how="inner").withColumn("_share", share)
    right = lookup(index, shared, _PAIR, ["_pairs"], limit, how="inner").withColumn("_share", F.explode(every_share))
    keys = [*_PAIR, "_share"]
    # A number of partitions that is asked for is not merged again for its few bytes.
    candidates = (
        left.select(*keys, "_labels", "_machines")
        .repartition(tasks, *keys)
        .join(right.select(*keys, "_pairs", "_ids").repartition(tasks, *keys), keys)
    )
    met = candidates.where(F.size(F.array_except("_pairs", "_labels")) == 0)
    return met.select(F.explode("_ids").alias("_selector"), "_machines").select(
        F.col("_selector").alias(selector_id), F.explode("_machines").alias(machine_id)
    )

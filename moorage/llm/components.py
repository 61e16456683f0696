"""Connected components and pairwise work on groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder that all executors share."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="moorage-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes: a logarithmic number
    of rounds in practice. Minima are combined map-side; joins are on checkpointed inputs,
    so that Spark can split the node in the middle of a large star. NULL ends are ignored.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )

    def mark(df: DataFrame):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = mark(edges)
    while before[0]:
        # Large star: neighbours larger than a node link to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: smaller neighbours of a node, and itself, link to the smallest.
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)


def paired_blocks(df: DataFrame, keys: list[str], spread: Column, block: int) -> DataFrame:
    """Rows with (``_lo``, ``_hi``): every two rows of a group meet in exactly one block pair.

    A group of at most ``block`` rows is one pair (0, 0). A larger one is cut by a hash of
    ``spread`` into chunks of about ``block`` rows, and every chunk is sent to its pair with
    each other: rows of a pair with ``_lo`` < ``_hi`` carry their side in ``_side``, and only
    rows of unlike sides are to be compared. At most N / block groups are large; their list
    is joined without a hint, so Spark decides by its size.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    large = sizes.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_chunks"))
    chunk = F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_chunks")).cast("int")
    marked = df.join(large, keys, "left").withColumn("_chunk", F.coalesce(chunk, F.lit(0)))
    others = F.sequence(F.lit(0), F.coalesce(F.col("_chunks"), F.lit(1)) - 1)
    return (
        marked.withColumn("_other", F.explode(others))
        .withColumn("_lo", F.least("_chunk", "_other"))
        .withColumn("_hi", F.greatest("_chunk", "_other"))
        .withColumn("_side", (F.col("_chunk") == F.col("_hi")).cast("int"))
        .drop("_chunks", "_chunk", "_other")
    )

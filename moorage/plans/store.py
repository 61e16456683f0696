"""A stored table of documents that takes edits partition by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import ini_documents, ini_rows, overlay_config
from ..operators.groups import lookup
from ..sources.scratch import written

# Partitions of a store, a number that stays with it. Each should hold 100 MB or more.
BUCKETS = 64


def _bucket(doc_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def write_document_store(
    docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    mode: str = "errorifexists",
) -> None:
    """Documents (doc_id, text) as Parquet in partitions by a hash of the id, sorted by id."""
    rows = docs.select(doc_id, F.col(text).alias("text")).withColumn("bucket", _bucket(doc_id, buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", doc_id).write.mode(mode).partitionBy("bucket").parquet(path)


def read_document_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, bucket); a filter on ``bucket`` reads only those partitions."""
    return spark.read.parquet(path)


def upsert_documents(
    spark: SparkSession, path: str, edits: DataFrame, *, doc_id: str = "doc_id", buckets: int = BUCKETS
) -> list[int]:
    """Upsert (doc_id, section, key, value) rows into the stored INI documents.

    An edited document becomes what ``overlay_config`` and ``ini_documents`` make of it, a document
    that is not there yet is made of its edits, and all others keep their texts as they are.
    Edits with a NULL id are no document's and are left out. Within the edits the later row of a
    key wins, by ``ord`` if they have it.

    Only the partitions that hold an edited document are read and replaced, and their numbers
    returned; the files of the others are not touched. The new rows are first written to the
    scratch folder and then swapped in partition by partition, so a job that fails before the
    swap leaves the store as it was, and one that fails in it is mended by the same edits again.
    ``buckets`` is the number that the store was written with.
    """
    edits = written(edits.where(F.col(doc_id).isNotNull()).withColumn("bucket", _bucket(doc_id, buckets)), "edits")
    # At most one row per partition of the store.
    touched = sorted(row.bucket for row in edits.select("bucket").distinct().collect())
    if not touched:
        return []
    stored = read_document_store(spark, path).where(F.col("bucket").isin(touched))
    asked = edits.select(doc_id).distinct().withColumn("_edited", F.lit(True))
    marked = lookup(stored.drop("bucket"), asked, [doc_id], [doc_id])
    base = ini_rows(marked.where("_edited"), doc_id=doc_id, doc="text")
    layers = [("stored", base), ("edits", edits.drop("bucket"))]
    # A text of the store is one row, however many keys it has.
    rendered = ini_documents(overlay_config(layers, doc_id=doc_id), doc_id=doc_id, part_keys=1 << 40)
    result = marked.where("_edited is null").select(doc_id, "text").unionByName(rendered.select(doc_id, "text"))
    staged = written(result.withColumn("bucket", _bucket(doc_id, buckets)), "store")
    (
        staged.repartition("bucket").sortWithinPartitions("bucket", doc_id)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )
    return touched

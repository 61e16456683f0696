"""Readers of listings, documents and config records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import config_schema


def _whole_files(spark: SparkSession, path: str, key: str, text: str) -> DataFrame:
    """One row per file in ``path`` or below: its path relative to it, and its text."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root)
    decoded = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # Compare without scheme and authority: "file:/x" and "file:///x" are one folder.
    place = F.regexp_replace(decoded, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    folder = whole.toUri().getPath().rstrip("/") + "/"
    below = F.when(F.startswith(place, F.lit(folder)), F.substring(place, len(folder) + 1, 1 << 30))
    # A path that names one file, or has a pattern, keys by the whole path.
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.coalesce(below, place).alias(key), F.col("value").alias(text))
    )


def read_package_listings(spark: SparkSession, path: str) -> DataFrame:
    """(package, text) from one listing file per package, for ``package_index``.

    ``package`` is the file's path relative to ``path``, with its extension.
    """
    return _whole_files(spark, path, "package", "text")


def read_ini_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc) from one INI file per document, for ``ini_rows``.

    ``doc_id`` is the file's path relative to ``path``, with its extension, so that files of
    one name in several folders stay apart.
    """
    return _whole_files(spark, path, "doc_id", "doc")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(json) from files with one JSON document per line; decoding is left to the operators."""
    return spark.read.text(path).select(F.col("value").alias("json"))


def read_configs(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Config records with the schema the field catalog declares."""
    return spark.read.format(file_format).schema(config_schema()).load(path)

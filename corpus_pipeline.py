"""Documents to training text, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and
returns a DataFrame; between stages the rows are written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.llm import decontaminate, linededup, queries, sentencepieces, simhash, toxicity
from moorage.llm.batches import DIGEST, with_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    found = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), keep=COLUMNS)
    return found.where("predicted = 0").select(COLUMNS)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines whose template recurs across documents."""
    cleaned = linededup.drop_recurring_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that of the smallest doc_id, NULL last, a single one.

    The operator has its own shingle length and bit distance. Rows are told apart by doc_id
    and text, so that repeated and NULL ids neither join what differs nor keep a copy.
    """
    identity = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *DIGEST)
    digested = with_digest(docs).withColumn("_row", identity)
    found = simhash.near_duplicates(digested, key="_row")
    first = found.where("_row = component_id").select("_row").distinct()
    kept = digested.join(first, "_row")
    return kept.dropDuplicates(["_row"]).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover a benchmark item: the text decides, whatever its doc_id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    digested = with_digest(docs)
    texts = digested.select(F.struct(*DIGEST).alias("digest"), "text")
    found = decontaminate.contamination(texts, benchmark, key="digest")
    tainted = found.where("contaminated").select("digest.*").distinct()
    return digested.join(tainted, DIGEST, "left_anti").select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decoded text, token count and digests of what is left."""
    found = sentencepieces.encode_decode(docs, queries.piece_model())
    return found.select("doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_recurring_lines),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

# Models and tilings are not expressible in SQL: tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = queries.shared_folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{base}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

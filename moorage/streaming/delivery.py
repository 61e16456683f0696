"""Delivery of telemetry that repeats nothing, loses nothing and never stops the stream.

Every micro-batch is written to folders of its own number, so a batch that runs again, after a
crash or from a lost checkpoint, replaces itself. What cannot be encoded, and what a
receiver refuses twice, is kept as dead letters; neither fails the stream.

Folders below the one that is given: ``outcomes/batch_id=N`` has a row per record that sends
telemetry, ``unsent/batch_id=N`` the documents of a batch that the receiver did not take.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..catalog import FIELDS, Field
from ..operators.telemetry import reportable, telemetry_documents

# Takes the documents (doc_id, json) of a batch and its number; raises if they are not taken.
Receiver = Callable[[DataFrame, int], None]

NO_TIME, UNKNOWN_RESOURCE, NOT_SENT = "no_time", "unknown_resource", "not_sent"
_EMPTY = -1
_log = logging.getLogger(__name__)


def encoded_telemetry(
    configs: DataFrame,
    fields: Sequence[Field] = FIELDS,
    *,
    doc_id: str = "config_id",
    resource: str = "resource",
    sent_at: str = "sent_at",
    **options,
) -> DataFrame:
    """(doc_id, json, reason): the document of each record, or why there is none.

    A record has no document if its kind is not in the catalog (``unknown_resource``) or its
    time is missing or no time (``no_time``; texts are parsed). Dead letters tell the id and the
    reason only: what a record holds may be secret.
    """
    if isinstance(configs.schema[sent_at].dataType, T.StringType):
        configs = configs.withColumn(sent_at, F.try_to_timestamp(sent_at))
    kinds = sorted({kind for field in fields for kind in field.resources})
    known = F.coalesce(F.col(resource).isin(*kinds), F.lit(False))
    reason = F.when(~known, UNKNOWN_RESOURCE).when(F.col(sent_at).isNull(), NO_TIME)
    keyed = configs.withColumn("_letter", F.struct(F.col(doc_id).alias("id"), reason.alias("reason")))
    documents = telemetry_documents(
        keyed.withColumn("_id", F.col(doc_id)), fields, doc_id="_letter", resource=resource, sent_at=sent_at,
        id_column="_id", **options,
    )
    return documents.select(
        F.col("_letter.id").alias(doc_id),
        F.when(F.col("_letter.reason").isNull(), F.col("json")).alias("json"),
        F.col("_letter.reason").alias("reason"),
    )


class Delivery:
    """Where telemetry is delivered: a folder that all executors share, and perhaps a receiver."""

    def __init__(
        self,
        path: str,
        key: T.StructField,
        *,
        receiver: Receiver | None = None,
        fields: Sequence[Field] = FIELDS,
        **options,
    ):
        """``key`` is the id column of the records; ``options`` go to ``encoded_telemetry``."""
        self.path, self.key, self.receiver = path.rstrip("/"), key, receiver
        self.fields, self.options = fields, options

    @property
    def _documents(self) -> T.StructType:
        return T.StructType([T.StructField(self.key.name, self.key.dataType), T.StructField("json", T.StringType())])

    def _put(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def _get(self, spark: SparkSession, table: str) -> DataFrame:
        """All batches of a table; one without rows stands there from the start."""
        schema = self._documents
        if table == "outcomes":
            schema = schema.add("reason", T.StringType())
        return spark.read.schema(schema.add("batch_id", T.LongType())).parquet(f"{self.path}/{table}")

    def prepare(self, spark: SparkSession) -> None:
        none = spark.createDataFrame([], self._documents)
        self._put(none.withColumn("reason", F.lit(None).cast("string")), "outcomes", _EMPTY)
        self._put(none, "unsent", _EMPTY)

    def deliver(self, configs: DataFrame, batch_id: int) -> None:
        """One micro-batch: encode, write, send. The same batch again changes nothing."""
        spark = configs.sparkSession
        sent = reportable(configs, doc_id=self.key.name)
        outcome = encoded_telemetry(sent, self.fields, doc_id=self.key.name, **self.options)
        self._put(outcome, "outcomes", batch_id)
        if self.receiver is None:
            return
        # Read back: what is sent is what was written, and is not encoded again.
        letters = self._get(spark, "outcomes").where(F.col("batch_id") == batch_id)
        documents = letters.where("reason is null").select(self._documents.names)
        taken = self._send(documents, batch_id)
        self._put(documents.limit(0) if taken else documents, "unsent", batch_id)

    def _send(self, documents: DataFrame, batch_id: int) -> bool:
        for attempt in (1, 2):
            try:
                self.receiver(documents, batch_id)
                return True
            except Exception as error:  # whatever a receiver raises, the stream goes on
                _log.warning("telemetry batch %d not taken, attempt %d: %s", batch_id, attempt, type(error).__name__)
        return False

    def start(self, configs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Deliver all that is available now; the same checkpoint resumes, a lost one repeats."""
        self.prepare(configs.sparkSession)
        return (
            configs.writeStream.foreachBatch(self.deliver)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """(doc_id, json, reason, batch_id): reason is NULL for what was delivered."""
        unsent = self._get(spark, "unsent").select("batch_id").distinct().withColumn("_unsent", F.lit(True))
        reason = F.coalesce("reason", F.when(F.col("_unsent"), NOT_SENT))
        joined = self._get(spark, "outcomes").join(unsent, "batch_id", "left")
        return joined.select(*self._documents.names, reason.alias("reason"), "batch_id")

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return self.outcomes(spark).where("reason is not null")

    def resend(self, spark: SparkSession) -> list[int]:
        """Send the batches that were not taken once more; the numbers of those that now are.

        The list that the driver goes through has an entry per refused batch, not per record.
        """
        unsent = self._get(spark, "unsent")
        refused = sorted(row.batch_id for row in unsent.select("batch_id").distinct().collect())
        taken = []
        for batch_id in refused:
            letters = self._get(spark, "outcomes").where((F.col("batch_id") == batch_id) & F.col("reason").isNull())
            documents = letters.select(self._documents.names)
            if self.receiver is None or self._send(documents, batch_id):
                self._put(documents.limit(0), "unsent", batch_id)
                taken.append(batch_id)
        return taken


def files_receiver(path: str) -> Receiver:
    """A receiver that writes the documents of a batch as JSON lines, replacing that batch's."""

    def receive(documents: DataFrame, batch_id: int) -> None:
        documents.select("json").write.mode("overwrite").text(f"{path.rstrip('/')}/batch_id={batch_id}")

    return receive

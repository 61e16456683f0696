"""The image to start machines from, per family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
CREATED_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSX"
READY = "READY"


def _created_at(images: DataFrame, created: str) -> Column:
    if isinstance(images.schema[created].dataType, T.StringType):
        # The zone is read from the text, so the session's zone does not matter.
        utc = F.when(F.col(created).endswith("Z"), F.col(created))
        return F.try_to_timestamp(utc, F.lit(CREATED_FORMAT))
    return F.col(created)


def latest_image(
    images: DataFrame,
    *,
    family: str = "family",
    created: str = "created",
    order: str = "ord",
    name: str = "name",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(family, ord, name, created, keep...): the newest image; the first listed wins a tie.

    ``keep`` names columns to return of the chosen image, such as its id or link. Text times
    are UTC with milliseconds, ``2024-03-31T02:45:00.000Z``.

    Images whose creation time does not parse are left to ``undated_images``.
    Combined map-side, so a family of any size costs one row per task.
    """
    image = F.struct(F.col(order).alias("ord"), F.col(name).alias("name"), created, *keep)
    newest = F.struct(F.col("_at"), -F.col(order).cast("bigint"))
    return (
        images.withColumn("_at", _created_at(images, created))
        .where(F.col("_at").isNotNull())
        .groupBy(family)
        .agg(F.max_by(image, newest).alias("_image"))
        .select(family, "_image.*")
    )


def undated_images(images: DataFrame, *, created: str = "created") -> DataFrame:
    """Images whose creation time does not parse."""
    return images.where(_created_at(images, created).isNull())


def latest_ready_image(
    images: DataFrame,
    *,
    family: str = "family",
    status: str = "status",
    order: str = "ord",
    name: str = "name",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(family, ord, name, keep...): the ready image with the last name in text order.

    The first listed wins a tie; ``keep`` names columns to return of the chosen image.
    """
    image = F.struct(F.col(order).alias("ord"), F.col(name).alias("name"), *keep)
    last = F.struct(F.col(name), -F.col(order).cast("bigint"))
    return (
        images.where((F.col(status) == READY) & F.col(name).isNotNull())
        .groupBy(family)
        .agg(F.max_by(image, last).alias("_image"))
        .select(family, "_image.*")
    )

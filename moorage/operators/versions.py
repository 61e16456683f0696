"""Package listings and version requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from .groups import GROUP_ROWS, lookup

# The marker of a version line, and the prefix per product.
VERSION_MARK = "Version"
SERVER_PREFIX = "Version: "
CLUSTER_PREFIX = "Version: 1:"


def package_index(
    listings: DataFrame,
    *,
    package: str = "package",
    text: str = "text",
    prefix: str = SERVER_PREFIX,
) -> DataFrame:
    """(package, ord, version) from package listings, one listing text per row.

    Lines containing the mark are kept, wherever it stands; the first ``prefix`` in
    the line is cut out, and a line without it passes unchanged. ``ord`` is the line
    number, so the first listed version has the least.
    """
    lines = listings.select(
        package, F.posexplode(F.split(F.col(text), "\n", -1)).alias("ord", "line")
    )
    at = F.instr(F.col("line"), prefix)
    cut = F.concat(
        F.substr(F.col("line"), F.lit(1), at - 1),
        F.substr(F.col("line"), at + len(prefix)),
    )
    return lines.where(F.contains(F.col("line"), F.lit(VERSION_MARK))).select(
        package, "ord", F.when(at > 0, cut).otherwise(F.col("line")).alias("version")
    )


def version_keys(
    listing: DataFrame, *, by: Sequence[str] = (), order: str = "ord", version: str = "version"
) -> DataFrame:
    """(by, kind, key, version, ord): the first listed version under every way to ask for it.

    Five rows per listed version, combined map-side to one per distinct key.
    """
    listed = F.col(version)
    without_revision = F.get(F.split(listed, "-"), 0)
    ways = {
        "default": F.lit(""),
        "major": semver.major(listed),
        "minor": semver.major_minor(listed),
        "text": listed,
        "canonical": semver.canonical(without_revision),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in ways.items()])
    return (
        listing.select(*by, order, version, F.inline(entries))
        .where(F.col("key").isNotNull())
        .groupBy(*by, "kind", "key")
        .agg(F.min_by(version, order).alias("version"), F.min(order).alias("ord"))
    )


def resolve_versions(
    requests: DataFrame,
    listing: DataFrame,
    *,
    request_id: str = "request_id",
    wanted: str = "wanted",
    by: Sequence[str] = (),
    order: str = "ord",
    version: str = "version",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(by, request_id, version, status): the first listed version that fits each request.

    ``8`` takes the first of major 8, ``8.0`` the first of 8.0, anything else the
    first that is the same text or, cut at its first dash, the same version; no
    request takes the first listed. Each distinct request is resolved once, and the
    answers go back to the requests by an equi-join that withstands a favourite
    version. Status: ``default``, ``found``, ``not_found`` or ``invalid``.
    """
    asked = F.coalesce(F.col(wanted), F.lit(""))
    keyed = requests.select(*by, request_id, asked.alias("_asked"))
    text = F.col("_asked")

    def probe(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    probes = (
        F.when(text == "", F.array(probe("default", text)))
        .when(text.rlike(semver.MAJOR_ONLY), F.array(probe("major", text)))
        .when(text.rlike(semver.MAJOR_MINOR_ONLY), F.array(probe("minor", text)))
        .otherwise(F.array(probe("text", text), probe("canonical", semver.canonical(text))))
    )
    probed = keyed.select(*by, "_asked").distinct().select(*by, "_asked", F.inline(probes))
    listed = version_keys(listing, by=by, order=order, version=version)
    answers = (
        lookup(probed, listed, [*by, "kind", "key"], ["_asked"], limit)
        .where(F.col("ord").isNotNull())
        .groupBy(*by, "_asked")
        .agg(F.min_by("version", "ord").alias("version"))
    )
    status = (
        F.when(F.col("version").isNotNull(), F.when(text == "", "default").otherwise("found"))
        .when((text == "") | semver.is_valid(text), "not_found")
        .otherwise("invalid")
    )
    return lookup(keyed, answers, [*by, "_asked"], [request_id], limit).select(
        *by, request_id, "version", status.alias("status")
    )

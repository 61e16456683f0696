"""Row fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a_64, fnv_64, murmur

ALGORITHMS = ("fnv1a_64", "fnv_64", "murmur")


def fingerprint_rows(
    df: DataFrame,
    columns: Sequence[str],
    algorithm: str = "fnv1a_64",
    *,
    into: str | None = None,
    separator: str = "\x1f",
) -> DataFrame:
    """Add an integer fingerprint of ``columns``.

    The FNV hashes take the text of the columns, joined by ``separator``. One column is
    hashed as it is, so equals the scalar function; a NULL in one column gives NULL, among
    several it counts as empty text. ``murmur`` chains the typed columns, each with the hash so
    far as seed, and skips a NULL; it has no separator.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}; known are {', '.join(ALGORITHMS)}")
    into = into or algorithm
    if algorithm == "murmur":
        return df.withColumn(into, murmur(*[F.col(c) for c in columns]))
    if len(columns) == 1:
        text = F.col(columns[0]).cast("string")
    else:
        blank = F.lit("")
        pieces = [F.coalesce(F.col(c).cast("string"), blank) for c in columns]
        text = F.concat_ws(separator, *pieces)
    return df.withColumn(into, (fnv1a_64 if algorithm == "fnv1a_64" else fnv_64)(text))

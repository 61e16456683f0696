"""Unset values, text forms and URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unset_if_zero(col: Column, data_type: T.DataType) -> Column:
    """NULL where a value is the zero of its type: '', 0, false, or nothing inside."""
    if isinstance(data_type, T.StringType):
        return F.nullif(col, F.lit(""))
    if isinstance(data_type, T.BooleanType):
        return F.nullif(col, F.lit(False))
    if isinstance(data_type, T.NumericType):
        return F.nullif(col, F.lit(0).cast(data_type))
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return F.when(F.size(col) > 0, col)
    return col


def rfc3339(col: Column, data_type: T.DataType) -> Column:
    """UTC time text with the fraction's trailing zeros trimmed, e.g. 2024-01-02T03:04:05.12Z.

    A zoned timestamp is moved to UTC through its microseconds, so the text does
    not depend on the session time zone. A timestamp without zone is taken as UTC.
    """
    if isinstance(data_type, T.TimestampType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        col = F.timestamp_add("MICROSECOND", F.unix_micros(col), epoch)
    return F.concat(F.replace(col.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def seconds_text(col: Column) -> Column:
    """Seconds with nine decimals and a unit, e.g. 0.673692200s."""
    return F.format_string("%.9fs", col.cast("double"))


# User info is everything up to the last '@' of the authority.
_USER_INFO = r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#]*@"


def has_user_info(col: Column) -> Column:
    return col.rlike(_USER_INFO)


def without_user_info(col: Column) -> Column:
    return F.regexp_replace(col, _USER_INFO, "$1")

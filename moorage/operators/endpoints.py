"""Monitoring endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import has_user_info, without_user_info

# Fixed values.
DEFAULT_PORTS = {"http": 80, "https": 443}

# Scheme, user info with its '@', host (bracketed if IPv6), port with its ':', the rest.
_URL = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
    r"((?:[^/?#]*@)?)"
    r"(\[[^\]/?#]*\]|[^:/?#@\[\]\s]*)"
    r"((?::[0-9]*)?)"
    r"((?:[/?#].*)?)$"
)

# A control character, or a percent sign in path or fragment that escapes nothing.
_BROKEN = (
    r"[\x00-\x1f\x7f]"
    r"|^[^?#]*%(?![0-9A-Fa-f]{2})"
    r"|#.*%(?![0-9A-Fa-f]{2})"
)


def normalize_endpoints(
    df: DataFrame,
    column: str,
    *,
    user_info: str | None = None,
    redact: bool = False,
    clear_path: bool = False,
) -> DataFrame:
    """Add ``endpoint``, ``has_userinfo`` and ``reason``.

    A URL of http or https without a port gets 80 or 443. Text without a scheme is
    rejected (``no_scheme``), as is a URL that does not parse (``unparsable``).
    ``user_info`` (``user:password``) is put in only where there is none and only
    when given; ``redact`` takes user info out; ``clear_path`` drops the path.
    """
    url = F.col(column)
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    given_user = F.regexp_extract(url, _URL, 2)
    host = F.regexp_extract(url, _URL, 3)
    given_port = F.regexp_extract(url, _URL, 4)
    rest = F.regexp_extract(url, _URL, 5)
    if redact:
        user = F.lit("")
    elif user_info is not None:
        user = F.when(given_user.isin("", "@"), F.lit(f"{user_info}@")).otherwise(given_user)
    else:
        user = given_user
    port = given_port
    for name, number in DEFAULT_PORTS.items():
        port = F.when(
            (scheme == name) & given_port.isin("", ":"), F.lit(f":{number}")
        ).otherwise(port)
    if clear_path:
        rest = F.regexp_replace(rest, r"^/[^?#]*", "")
    reason = F.when(
        url.isNull() | ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "no_scheme"
    ).when(~url.rlike(_URL) | url.rlike(_BROKEN), "unparsable")
    endpoint = F.concat(scheme, F.lit("://"), user, host, port, rest)
    return df.withColumns(
        {
            "endpoint": F.when(reason.isNull(), endpoint),
            "has_userinfo": F.coalesce(has_user_info(url), F.lit(False)),
            "reason": reason,
        }
    )


def redact_endpoints(df: DataFrame, column: str) -> DataFrame:
    """Take user info out of a URL column in place."""
    return df.withColumn(column, without_user_info(F.col(column)))

"""Semantic version text as column expressions. Short forms (8, 8.0) are valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(?:0|[1-9][0-9]*)"
_PRE_PART = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z\-][0-9A-Za-z\-]*)"
_PRE = rf"-{_PRE_PART}(?:\.{_PRE_PART})*"
_BUILD = r"\+[0-9A-Za-z\-]+(?:\.[0-9A-Za-z\-]+)*"

# Prerelease and build are allowed only after all three numbers.
VALID = rf"^{_NUMBER}(?:\.{_NUMBER}(?:\.{_NUMBER}(?:{_PRE})?(?:{_BUILD})?)?)?\z"
MAJOR_ONLY = rf"^{_NUMBER}\z"
MAJOR_MINOR_ONLY = rf"^{_NUMBER}\.{_NUMBER}\z"


def is_valid(version: Column) -> Column:
    return version.rlike(VALID)


def _numbers(version: Column) -> Column:
    return F.split(F.regexp_extract(version, r"^[0-9.]*", 0), r"\.")


def major(version: Column) -> Column:
    """Major number, NULL for an invalid version."""
    return F.when(is_valid(version), F.get(_numbers(version), 0))


def major_minor(version: Column) -> Column:
    """Major and minor, a missing minor counting as 0; NULL for an invalid version."""
    numbers = _numbers(version)
    return F.when(
        is_valid(version),
        F.concat_ws(".", F.get(numbers, 0), F.coalesce(F.get(numbers, 1), F.lit("0"))),
    )


def canonical(version: Column) -> Column:
    """Three numbers and the prerelease, without build; NULL for an invalid version.

    Two versions are equal exactly when their canonical texts are.
    """
    numbers = _numbers(version)
    return F.when(
        is_valid(version),
        F.concat(
            F.concat_ws(
                ".",
                F.get(numbers, 0),
                F.coalesce(F.get(numbers, 1), F.lit("0")),
                F.coalesce(F.get(numbers, 2), F.lit("0")),
            ),
            F.regexp_extract(version, r"^[0-9.]+(-[^+]*)", 1),
        ),
    )

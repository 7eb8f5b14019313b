"""Number base conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_base10(digits: Column, base: int) -> Column:
    """Digits in ``base`` (2..36) -> BIGINT."""
    if not 2 <= base <= 36:
        raise ValueError("bases 2..36 are supported")
    return F.conv(digits, base, 10).cast("long")


def from_base10(n: Column, base: int) -> Column:
    """BIGINT -> digits in ``base`` (2..36), with a minus sign for negative numbers.

    Digits above 9 are upper-case letters in every base.  ``bc`` does the same
    up to base 16 only; beyond, it prints decimal digit groups, which is a
    deliberate deviation here.
    """
    if not 2 <= base <= 36:
        raise ValueError("bases 2..36 are supported")
    text = n.cast("string")
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.conv(F.ltrim(text, F.lit("-")), 10, base))


def parse_count(s: Column) -> Column:
    """Strictly numeric text -> BIGINT; anything else is an error (``isnumeric`` + ``int``)."""
    return F.when(s.rlike("^[0-9]+$"), s.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(s, F.lit("NULL")))))

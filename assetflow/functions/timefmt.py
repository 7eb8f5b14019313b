"""Epoch conversions in seconds, milliseconds, microseconds and nanoseconds.

Spark timestamps carry microseconds, so nanosecond epochs stay BIGINT and
conversions from a finer unit integer-divide down to whole seconds first,
exactly like the shell helpers they replace.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_FACTOR = {"s": 1, "ms": 1000, "us": 1000_000, "ns": 1000_000_000}

# Display formats.
PRETTY_FORMAT = "yyyy-MM-dd-HH:mm:ss"
LABEL_FORMAT = "yyyy-MM-dd-HH-mm-ss"
SORTABLE_FORMAT = "yyyy-MM-dd-HH:mm:ss"
MAC_INPUT_FORMAT = "MM-dd-yyyy_H:m:s"


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def utc_micros(ts: Column, ntz: bool = False) -> Column:
    """Microseconds since the epoch.  A TIMESTAMP_NTZ (``ntz=True``) is read as
    UTC wall-clock time, independent of the session zone."""
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), ts)
    return F.unix_micros(ts.cast("timestamp"))


def epoch_from_timestamp(ts: Column, unit: str = "s", ntz: bool = False) -> Column:
    """Timestamp -> integer epoch in ``unit`` (s/ms/us/ns); finer digits are truncated."""
    if unit not in UNIT_FACTOR:
        raise ValueError(unit)
    us = utc_micros(ts, ntz)
    if unit == "ns":
        return us * 1000
    if unit == "us":
        return us
    return F.floor(us / (1000_000 // UNIT_FACTOR[unit])).cast("long")


def epoch_from_string(s: Column, fmt: str = "yyyy-MM-dd HH:mm:ss", unit: str = "s",
                      tz: str | None = None) -> Column:
    """Datetime text -> integer epoch in ``unit``.

    ``tz=None`` reads the text in the session zone (like ``date -d``); a zone
    name reads it in that zone, whatever the session zone is.
    """
    if tz is None:
        return epoch_from_timestamp(F.to_timestamp(s, fmt), unit)
    wall = F.to_timestamp_ntz(s, F.lit(fmt))
    utc_wall = wall if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
    return epoch_from_timestamp(utc_wall, unit, ntz=True)


def wall_clock(epoch: Column, unit: str = "s", tz: str = "UTC") -> Column:
    """Epoch -> TIMESTAMP_NTZ wall-clock time in zone ``tz`` (whole seconds)."""
    secs = epoch if unit == "s" else F.floor(epoch / UNIT_FACTOR[unit])
    utc = F.timestamp_add("SECOND", secs.cast("long"), F.expr(_EPOCH_NTZ))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def timestamp_from_epoch(epoch: Column, unit: str = "s") -> Column:
    """Integer epoch in ``unit`` -> timestamp (instant) truncated to whole seconds."""
    secs = F.floor(epoch / UNIT_FACTOR[unit]) if unit != "s" else epoch
    return F.timestamp_seconds(secs.cast("long"))


def format_epoch(epoch: Column, unit: str = "s", tz: str = "UTC") -> Column:
    """Epoch -> ``yyyy-MM-dd-HH:mm:ss.nnnnnnnnn`` in zone ``tz``.

    Finer units are integer-divided to whole seconds first, so the
    fraction is always nine zeros, like ``date -d@<secs> +%N``.
    """
    return F.concat(F.date_format(wall_clock(epoch, unit, tz), PRETTY_FORMAT), F.lit(".000000000"))


def time_label(ts: Column, pretty: bool = False) -> Column:
    """Sortable label of a timestamp (the two ``datelocal`` formats)."""
    if pretty:
        return F.concat(F.date_format(ts, PRETTY_FORMAT), F.lit("."),
                        F.lpad((F.unix_micros(ts.cast("timestamp")) % 1000000 * 1000).cast("string"), 9, "0"))
    return F.date_format(ts, LABEL_FORMAT)


def epoch_now(unit: str = "s") -> Column:
    """Current epoch in ``unit`` (nanoseconds carry microsecond precision)."""
    return epoch_from_timestamp(F.current_timestamp(), unit)

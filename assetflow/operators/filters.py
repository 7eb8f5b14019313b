"""Name, size, pattern and type predicates on asset rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.paths import basename

# Suffixes skipped by the duplicate finder (system, developer,
# video, note and unreadable image files), compared case-insensitively.
SKIP_SUFFIXES = (".ds_store", ".html", ".json", ".py", ".avi", ".mov", ".mp4", ".txt", ".webp")
# Suffixes the scoring report accepts.
ALLOW_SUFFIXES = (".jpeg", ".jpg", ".png")
# Size rules.
MAX_ASSET_BYTES = 10 * 2 ** 20
CLEANUP_MIN_BYTES = 20 * 1024
# System file suffix excluded from structure-keeping moves.
SYSTEM_SUFFIXES = (".ds_store",)


def _any(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def suffix_in(path: Column, suffixes) -> Column:
    low = F.lower(path)
    return _any(low.endswith(s) for s in suffixes)


def skip_condition(path: Column, size: Column | None = None, max_size: int | None = MAX_ASSET_BYTES,
                   suffixes=SKIP_SUFFIXES) -> Column:
    """True for rows to skip: denylisted suffix, or size strictly above ``max_size``."""
    cond = suffix_in(path, suffixes)
    if size is not None and max_size is not None:
        cond = cond | (size > max_size)
    return cond


def skip_filter(df: DataFrame, path: str = "path", size: str | None = "size",
                max_size: int | None = MAX_ASSET_BYTES) -> DataFrame:
    """Drop denylisted and oversized assets (filter on name/size before any content read)."""
    return df.filter(~skip_condition(F.col(path), F.col(size) if size else None, max_size))


def allow_filter(df: DataFrame, path: str = "path", suffixes=ALLOW_SUFFIXES) -> DataFrame:
    """Keep only allowlisted image suffixes."""
    return df.filter(suffix_in(F.col(path), suffixes))


def regex_any(name: Column, patterns) -> Column:
    """True when any pattern matches at the start of ``name`` (``re.match`` semantics).

    Patterns are Java regular expressions.
    """
    return _any(name.rlike(f"^(?:{p})") for p in patterns)


def cleanup_class(size: Column, name: Column, valid: Column | None,
                  size_threshold: int = CLEANUP_MIN_BYTES, patterns=()) -> Column:
    """First rule that fires: ``small`` (size < threshold), ``pattern``,
    ``invalid`` (not decodable), else ``keep``."""
    c = F.when(size < size_threshold, F.lit("small"))
    if patterns:
        c = c.when(regex_any(name, patterns), F.lit("pattern"))
    if valid is not None:
        c = c.when(~valid, F.lit("invalid"))
    return c.otherwise(F.lit("keep"))


def cleanup_classify(df: DataFrame, path: str = "path", size: str = "size", valid: str | None = None,
                     size_threshold: int = CLEANUP_MIN_BYTES, patterns=()) -> DataFrame:
    """Skip denylisted names (size is not checked), then classify each asset."""
    kept = df.filter(~skip_condition(F.col(path), None, None))
    return kept.withColumn("action", cleanup_class(
        F.col(size), basename(F.col(path)), F.col(valid) if valid else None, size_threshold, patterns))


# File signatures, first bytes as lower-case hex.
MAGIC_SIGNATURES = (
    ("89504e47", "PNG"),
    ("47494638", "GIF"),
    ("ffd8ffe0", "JPEG"),
    ("ffd8ffe1", "JPEG"),
    ("ffd8ffee", "JPEG"),
    ("ffd8ffdb", "JPEG"),
    ("52494646", "RIFF/WEBP"),
)
BMP_PREFIX = "424d"


WEBP_TAG = "57454250"  # fixed value: bytes 9-12 of a WebP file ("WEBP")


def magic_type(content: Column, check_webp: bool = False) -> Column:
    """Type from the first four bytes (zero-padded hex); ``UNKNOWN`` otherwise.

    Any RIFF container is labelled ``RIFF/WEBP`` like the original; with
    ``check_webp`` bytes 9-12 decide between ``WEBP`` and ``RIFF``.
    """
    head = F.lower(F.hex(F.substring(content, 1, 4)))
    c = None
    if check_webp:
        riff = head == "52494646"
        tag = F.upper(F.hex(F.substring(content, 9, 4)))
        c = F.when(riff & (tag == WEBP_TAG), F.lit("WEBP")).when(riff, F.lit("RIFF"))
    for sig, kind in MAGIC_SIGNATURES:
        c = F.when(head == sig, F.lit(kind)) if c is None else c.when(head == sig, F.lit(kind))
    return c.when(head.startswith(BMP_PREFIX), F.lit("BMP")).otherwise(F.lit("UNKNOWN"))


def image_only(df: DataFrame, mime: str = "mime", content: str = "content") -> DataFrame:
    """Keep rows whose declared type mentions ``image`` or whose signature is known.

    The signature is only evaluated for rows failing the declared-type test.
    """
    declared = F.coalesce(F.col(mime).contains("image"), F.lit(False))
    return df.filter(declared | (magic_type(F.col(content)) != "UNKNOWN"))

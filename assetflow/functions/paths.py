"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory; '' for a bare name."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def relative_path(path: Column, root: str) -> Column:
    """``path`` relative to ``root`` (both without trailing slash)."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)) \
        .otherwise(path)


def rebase(relpath: Column, new_root: str) -> Column:
    """Keep the relative path under a new root."""
    return F.concat(F.lit(new_root.rstrip("/") + "/"), relpath)


def split_name_ext(name: Column):
    """(name, ext) split on the last dot; a name without a dot is all extension."""
    has_dot = F.instr(name, ".") > 0
    stem = F.when(has_dot, F.regexp_extract(name, "^(.*)\\.[^.]*$", 1)).otherwise(F.lit(""))
    ext = F.substring_index(name, ".", -1)
    return stem, ext


def flat_name(relpath: Column, suffix_len: int = 16) -> Column:
    """Flattened, collision-avoiding name ``stem.<suffix>.ext``.

    The suffix is derived from the relative path (sha2) instead of a random
    draw, so a retried task produces the same plan.
    """
    name = basename(relpath)
    stem, ext = split_name_ext(name)
    suffix = F.substring(F.sha2(relpath, 256), 1, suffix_len)
    return F.concat_ws(".", stem, suffix, ext)


def ancestors(path: Column) -> Column:
    """All proper ancestor directories of a file path, shallowest first.

    ``a/b/c.txt`` -> ``['a', 'a/b']``; a bare name has none.
    """
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    return F.when(n <= 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def quote_path(path: Column) -> Column:
    """URL percent-encoding that keeps ``/`` and encodes space as ``%20``."""
    enc = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc

"""Move plans: DataFrames of (src, dst) rows instead of file-system side effects.

Executing a plan is the caller's step; every plan here is deterministic, so
a retried task produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.paths import dirname, flat_name, rebase, relative_path
from assetflow.operators import filters
from assetflow.operators.salting import salted_join

PREVIEW_ROWS = 30  # fixed value: rows shown by a dry run


def move_plan(df: DataFrame, dst_root: str, src_root: str | None = None, path: str = "path",
              keep_structure: bool = True, skip_system: bool = True, carry=()) -> DataFrame:
    """Plan moving every file under ``dst_root``.

    ``keep_structure`` keeps the path relative to ``src_root``; otherwise the
    file is flattened to ``stem.<16 chars>.ext`` (chars from sha2 of the
    relative path).  System files (``.ds_store``) are left alone.  Columns in
    ``carry`` come along.
    """
    rows = df
    if skip_system:
        rows = rows.filter(~filters.suffix_in(F.col(path), filters.SYSTEM_SUFFIXES))
    rel = relative_path(F.col(path), src_root) if src_root else F.col(path)
    if keep_structure:
        dst = rebase(rel, dst_root)
    else:
        dst = F.concat(F.lit(dst_root.rstrip("/") + "/"), flat_name(rel))
    return (rows.select(F.col(path).alias("src"), dst.alias("dst"), *carry)
            .select("src", "dst", dirname(F.col("dst")).alias("dst_dir"), *carry))


def needed_dirs(plan: DataFrame) -> DataFrame:
    """Destination directories to create (one row each)."""
    return plan.select("dst_dir").distinct()


def move_conflicts(plan: DataFrame, existing: DataFrame | None = None, existing_path: str = "path") -> DataFrame:
    """Plan rows whose destination is taken: already existing, or claimed by
    more than one plan row.  ``reason`` says which (``exists`` wins)."""
    claims = plan.groupBy("dst").agg(F.count(F.lit(1)).alias("n_claims"))
    if existing is not None:
        ex = existing.select(F.col(existing_path).alias("dst")).distinct().withColumn("_exists", F.lit(True))
        claims = claims.join(ex, "dst", "left")
        exists = F.coalesce(F.col("_exists"), F.lit(False))
    else:
        exists = F.lit(False)
    reason = F.when(exists, F.lit("exists")).when(F.col("n_claims") > 1, F.lit("duplicate"))
    taken = claims.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    # only taken destinations are joined back; a destination claimed by many rows is dealt over tasks
    return salted_join(plan, taken, ["dst"], ["src"]).select("src", "dst", "n_claims", "reason")


def cleanup_plan(df: DataFrame, dst_root: str, src_root: str | None = None, path: str = "path",
                 size: str = "size", valid: str | None = None,
                 size_threshold: int = filters.CLEANUP_MIN_BYTES, patterns=(),
                 keep_structure: bool = True) -> DataFrame:
    """Classify assets (small / pattern / invalid / keep) and plan moving all but ``keep``."""
    cls = filters.cleanup_classify(df, path, size, valid, size_threshold, patterns)
    moving = cls.filter(F.col("action") != "keep")
    return move_plan(moving, dst_root, src_root, path, keep_structure, skip_system=False, carry=("action",))


def preview(plan: DataFrame, n: int = PREVIEW_ROWS, order: Column | str = "src") -> DataFrame:
    """Dry-run view: the first ``n`` plan rows by source path."""
    return plan.orderBy(order).limit(n)

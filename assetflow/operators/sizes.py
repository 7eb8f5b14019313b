"""Sizes: largest files and cumulative directory sizes (a hierarchical rollup).

Every file contributes its size to each ancestor directory; the per-directory
sum is partially aggregated, so the root directory (which receives every
file) costs one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.functions.paths import ancestors

LARGE_BYTES = 50 * 2 ** 20   # fixed value: default "larger than" threshold
LARGEST_N = 20               # fixed value: default number of largest files
DIR_TOP_N = 30               # fixed value: default entries of the size top list


def largest(files: DataFrame, threshold: int = LARGE_BYTES, n: int = LARGEST_N,
            path: str = "path", size: str = "size") -> DataFrame:
    """Files strictly larger than ``threshold``, biggest first, first ``n``."""
    return files.filter(F.col(size) > threshold).orderBy(F.col(size).desc(), F.col(path)).limit(n)


def dir_sizes(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Total bytes and file count under every directory at every depth."""
    return (files.select(F.explode_outer(ancestors(F.col(path))).alias("dir"), F.col(size))
            .filter(F.col("dir").isNotNull())
            .groupBy("dir").agg(F.sum(size).cast("long").alias("total_size"),
                                F.count(F.lit(1)).alias("n_files"))
            .withColumn("depth", F.size(F.split("dir", "/")).cast("long")))


def dir_total(files: DataFrame, size: str = "size") -> DataFrame:
    """Total bytes of the whole tree (depth 0)."""
    return files.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size"),
                     F.count(F.lit(1)).alias("n_files"))


def size_top(files: DataFrame, n: int = DIR_TOP_N, path: str = "path", size: str = "size") -> DataFrame:
    """Top ``n`` entries (files and directories) by cumulative size."""
    dirs = dir_sizes(files, path, size).select(F.col("dir").alias("entry"), "total_size",
                                               F.lit("dir").alias("kind"))
    fl = files.select(F.col(path).alias("entry"), F.col(size).cast("long").alias("total_size"),
                      F.lit("file").alias("kind"))
    return dirs.unionByName(fl).orderBy(F.col("total_size").desc(), F.col("entry")).limit(n)

"""Incremental computation against a cache table keyed by (path, size).

A cache is a table of previous results.  Hits are reused, misses are
computed, and the new cache holds only files that still exist.  A new cache
version is written to a new folder; the version being read is never
overwritten.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetflow.session import scratch_table

CACHE_KEYS = ("path", "size")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def load_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The cache at ``path``, or an empty frame of the same schema."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def split_by_cache(current: DataFrame, cache: DataFrame, keys=CACHE_KEYS):
    """(hits with cached columns, misses) of the current files."""
    k = list(keys)
    hits = current.join(cache, k, "inner")
    misses = current.join(cache.select(*k), k, "left_anti")
    return hits, misses


def cache_status(current: DataFrame, cache: DataFrame, keys=CACHE_KEYS) -> DataFrame:
    """Every current file with ``hit`` or ``miss``."""
    k = list(keys)
    marks = cache.select(*k).distinct().withColumn("_hit", F.lit(True))
    return current.join(marks, k, "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit("hit")).otherwise(F.lit("miss"))).drop("_hit")


def refresh(current: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame],
            keys=CACHE_KEYS, complete: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """New cache = cached rows of files still present (and complete) + fresh rows
    for the rest.  ``compute`` receives only the misses; stale entries vanish.

    Keys are compared first, so with few misses (which Spark then broadcasts by their
    size) the other columns of ``current``, file contents say, are not shuffled.
    """
    k = list(keys)
    usable = complete(cache) if complete else cache
    present = usable.join(current.select(*k), k, "left_semi")
    missing = scratch_table(current.select(*k).distinct().join(usable.select(*k), k, "left_anti"), "cache-misses")
    fresh = compute(current.join(missing, k, "left_semi"))
    return present.unionByName(fresh.select(*present.columns))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a cache version to its own folder and return the folder."""
    out = f"{root.rstrip('/')}/v={version:06d}"
    df.write.mode("overwrite").parquet(out)
    return out

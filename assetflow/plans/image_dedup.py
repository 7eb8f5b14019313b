"""Duplicate images in a folder tree: hashes, groups and a keep/move plan.

Two scans, one of decoded pixels and one of bytes, each pruned by name and
size when Spark lists the folder.  Hashes are computed on the scanned rows;
only paths, sizes and hashes are joined.  With a cache, a file's known hash
types are reused and only the missing ones are computed, so a new hash type
costs that type alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetflow.functions import hashing
from assetflow.functions.paths import relative_path
from assetflow.functions.thumbnails import phash_map_from_thumbs, with_thumbnails
from assetflow.operators import dedup, filters
from assetflow.plans import cache
from assetflow.session import scratch_table
from assetflow.sources import files

CACHE_SCHEMA = StructType.fromDDL("path string, size long, w long, h long, hashes map<string,string>")
MD5 = "md5"


def hash_types() -> list[str]:
    return [MD5, *(hashing.phash_name(s, b) for s, b in hashing.PHASH_CONFIGS)]


def _only(hashes: Column, missing: Column | None) -> Column:
    """The entries of a hash map that are asked for; all without ``missing``."""
    return hashes if missing is None else F.map_filter(hashes, lambda k, _: F.array_contains(missing, k))


def _narrow(scan: DataFrame, todo: DataFrame | None, wanted: Column) -> tuple[DataFrame, Column | None]:
    """The scan's rows that still need a hash, with the types they lack.

    ``todo`` has paths, sizes and type names only, and Spark knows its size: an
    ordinary refresh broadcasts it and no bytes are shuffled.
    """
    if todo is None:
        return scan, None
    return scan.join(todo.filter(wanted).select("path", "size", "missing"), ["path", "size"]), F.col("missing")


def hashed_files(spark: SparkSession, root: str, max_size: int = filters.MAX_ASSET_BYTES,
                 cached: DataFrame | None = None) -> DataFrame:
    """One row per image file under ``root``: relative path, size, w, h and the hashes it has.

    A file that cannot be decoded has only its content hash, and no w and h.

    ``cached`` (``CACHE_SCHEMA``, unique by path and size) holds earlier results;
    a file of the same path and size keeps its hashes and gets those it lacks.
    """
    def named(df: DataFrame) -> DataFrame:
        return filters.skip_filter(df, "path", "size", max_size).withColumn(
            "path", relative_path(F.col("path"), root.rstrip("/")))

    listing = named(files.list_files(spark, root)).select("path", "size")
    types = F.array(*[F.lit(t) for t in hash_types()])
    todo = None
    if cached is None:
        known = listing.select("path", "size", *[F.lit(None).cast(CACHE_SCHEMA[c].dataType).alias(c) for c in ("w", "h", "hashes")])
    else:
        known = scratch_table(listing.join(cached, ["path", "size"], "left").select(*CACHE_SCHEMA.names), "image-hashes")
        have = F.coalesce(F.map_keys("hashes"), F.array().cast("array<string>"))
        todo = known.withColumn("missing", F.array_except(types, have)).filter(F.size("missing") > 0)

    images = named(files.read_images(spark, root, max_size=max_size)).filter("valid")
    images, lacks = _narrow(images, todo, F.exists("missing", lambda t: t != MD5) if todo is not None else None)
    pixel = with_thumbnails(images).select(
        "path", "size", F.col("width").cast("long").alias("new_w"), F.col("height").cast("long").alias("new_h"),
        _only(phash_map_from_thumbs(F.col("thumbs")), lacks).alias("new_pixel"))
    content = named(files.read_files(spark, root)).select("path", "size", "content")
    content, lacks = _narrow(content, todo, F.array_contains("missing", MD5) if todo is not None else None)
    digest = content.select("path", "size", F.create_map(F.lit(MD5), hashing.content_md5(F.col("content"))).alias("new_md5"))

    none = F.create_map().cast("map<string,string>")
    return known.join(pixel, ["path", "size"], "left").join(digest, ["path", "size"], "left").select(
        "path", "size", F.coalesce("w", "new_w").alias("w"), F.coalesce("h", "new_h").alias("h"),
        F.map_concat(*[F.coalesce(F.col(c), none) for c in ("hashes", "new_md5", "new_pixel")]).alias("hashes"))


def hashed_images(spark: SparkSession, root: str, max_size: int = filters.MAX_ASSET_BYTES,
                  cached: DataFrame | None = None) -> DataFrame:
    """The rows of ``hashed_files`` that have every hash, i.e. the decodable images."""
    return dedup.complete_hashes(hashed_files(spark, root, max_size, cached), len(hash_types()))


def refresh_hashes(spark: SparkSession, root: str, cache_in: str | None, cache_out: str,
                   max_size: int = filters.MAX_ASSET_BYTES) -> DataFrame:
    """Hashes of the current files, written as a new cache version and read back; files that are gone leave the cache.

    Returns the rows with all hashes; the folder also has those with some, so an undecodable file
    keeps its content hash.  ``image_dedup_plan`` takes the whole folder as ``cached``.
    """
    old = cache.load_or_empty(spark, cache_in, CACHE_SCHEMA) if cache_in else None
    hashed_files(spark, root, max_size, old).write.mode("overwrite").parquet(cache_out)
    return dedup.complete_hashes(spark.read.schema(CACHE_SCHEMA).parquet(cache_out), len(hash_types()))


def image_dedup_plan(spark: SparkSession, root: str, hash_type: str = MD5, dst_root: str | None = None,
                     max_size: int = filters.MAX_ASSET_BYTES, cached: DataFrame | None = None) -> DataFrame:
    """Keep/move plan for the duplicate groups of one hash type."""
    if hash_type not in hash_types():
        raise ValueError(f"unknown hash type {hash_type}")
    fam = dedup.md5_family() if hash_type == MD5 else dedup.image_phash_family()
    long = dedup.hash_long(hashed_images(spark, root, max_size, cached)).filter(F.col("hash_type") == hash_type)
    return dedup.dedup_plan(long, fam, dst_root)

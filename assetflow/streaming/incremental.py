"""Incremental hashing of newly arriving files (Structured Streaming).

The file source tracks which input files were already seen; each
micro-batch anti-joins its rows against the cache on (path, size), computes
hashes only for the misses, and writes them to a folder named after the
stream's id (from its checkpoint) and the batch id.  A batch that runs again
ignores what it or a later batch of the same stream has written, computes the
same misses and overwrites the same folder: nothing is lost and the cache
never holds a batch twice.  A new checkpoint is a new stream; it reuses the
rows of earlier streams and writes beside them.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assetflow.plans.cache import CACHE_KEYS, load_or_empty


def start_incremental_hashing(spark: SparkSession, source: DataFrame, cache_dir: str, cache_schema: StructType,
                              compute: Callable[[DataFrame], DataFrame], checkpoint_dir: str,
                              available_now: bool = True, keys=CACHE_KEYS) -> StreamingQuery:
    """Start the stream; ``source`` is a streaming frame with the key columns.

    ``compute(misses)`` must return rows of ``cache_schema``.
    """
    k = list(keys)
    cache_root = cache_dir.rstrip("/")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        meta = batch.sparkSession.read.text(f"{checkpoint_dir.rstrip('/')}/metadata").first()
        run = json.loads(meta["value"])["id"]
        stored = StructType([*cache_schema.fields, StructField("run", StringType()), StructField("batch", LongType())])
        cached = load_or_empty(batch.sparkSession, cache_root, stored)
        cached = cached.filter(~F.col("run").eqNullSafe(run) | (F.col("batch") < batch_id))
        # only the cache keys of this batch's files: a semi-join whose small side
        # (the batch) AQE broadcasts, so the growing cache is scanned, not shuffled
        keys = batch.select(*k).distinct()
        known = cached.select(*k).join(keys, k, "left_semi")
        misses = batch.join(known, k, "left_anti")
        out = compute(misses).select(*cache_schema.fieldNames())
        out.write.mode("overwrite").parquet(f"{cache_root}/run={run}/batch={batch_id:09d}")

    w = source.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a folder with a declared schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def md5_of(content: str = "content"):
    """A ``compute`` for ``start_incremental_hashing``: path, size, md5."""
    return lambda misses: misses.select("path", "size", F.md5(F.col(content)).alias("md5"))

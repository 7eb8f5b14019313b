"""Structured Streaming: incremental hashing and running toggle counts."""
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assetflow.streaming import incremental, toggles

SRC = StructType([StructField("path", StringType()), StructField("size", LongType()),
                  StructField("content", StringType())])
CACHE = StructType([StructField("path", StringType()), StructField("size", LongType()),
                    StructField("md5", StringType())])


def test_incremental_hashing(spark, tmpdir_path):
    src, cache_dir, ck = f"{tmpdir_path}/in", f"{tmpdir_path}/cache", f"{tmpdir_path}/ck"
    spark.createDataFrame([(f"f{i}", i, f"c{i}") for i in range(10)], SRC).write.mode("append").parquet(src)
    q = incremental.start_incremental_hashing(spark, incremental.file_stream(spark, src, SRC), cache_dir, CACHE,
                                              incremental.md5_of(), ck)
    q.awaitTermination()
    assert spark.read.parquet(cache_dir).count() == 10
    # a second delivery repeats three known files and brings five new ones
    spark.createDataFrame([(f"f{i}", i, f"c{i}") for i in range(7, 15)], SRC).write.mode("append").parquet(src)
    q = incremental.start_incremental_hashing(spark, incremental.file_stream(spark, src, SRC), cache_dir, CACHE,
                                              incremental.md5_of(), ck)
    q.awaitTermination()
    c = spark.read.parquet(cache_dir)
    assert c.count() == 15 and c.select("path").distinct().count() == 15


def test_incremental_hashing_survives_retries(spark, tmpdir_path):
    import shutil
    src, cache_dir = f"{tmpdir_path}/in", f"{tmpdir_path}/cache"
    spark.createDataFrame([(f"f{i}", i, f"c{i}") for i in range(10)], SRC).write.parquet(src)

    def deliver(ck):
        incremental.start_incremental_hashing(spark, incremental.file_stream(spark, src, SRC), cache_dir, CACHE,
                                              incremental.md5_of(), ck).awaitTermination()
        return spark.read.parquet(cache_dir)

    deliver(f"{tmpdir_path}/ck")
    # the batch ran, its commit was lost: the same batch id runs again
    for name in ("0", ".0.crc"):
        shutil.move(f"{tmpdir_path}/ck/commits/{name}", f"{tmpdir_path}/lost{name}")
    c = deliver(f"{tmpdir_path}/ck")
    assert c.count() == 10 and c.select("path").distinct().count() == 10
    # a new checkpoint on the old cache finds everything in it
    c = deliver(f"{tmpdir_path}/ck2")
    assert c.count() == 10 and c.select("path").distinct().count() == 10


def test_running_toggle_counts(spark, tmpdir_path):
    schema = "seq long, kind string, item string"
    spark.createDataFrame([(1, "toggle", "x"), (2, "toggle", "y"), (3, "toggle", "x"), (4, "reset", None)],
                          schema).write.parquet(f"{tmpdir_path}/log")
    stream = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/log")
    q = (toggles.running_toggle_counts(stream).writeStream.outputMode("update").format("memory")
         .queryName("toggle_counts_test").option("checkpointLocation", f"{tmpdir_path}/ck").start())
    q.processAllAvailable()
    q.stop()
    got = {r.item: (r.n_toggles, r.moved) for r in spark.table("toggle_counts_test").collect()}
    assert got == {"x": (2, False), "y": (1, True)}


def test_reset_aware_toggle_counter_stream(spark, tmpdir_path):
    import random

    from assetflow.operators import toggle
    rnd = random.Random(9)
    rows, seq = [], 0
    for part in range(4):
        chunk = []
        for _ in range(40):
            seq += 1
            kind = "reset" if rnd.random() < 0.08 else "toggle"
            chunk.append((seq, kind, None if kind == "reset" else f"i{rnd.randrange(6)}"))
        rows += chunk
        spark.createDataFrame(chunk, "seq long, kind string, item string").coalesce(1) \
            .write.mode("append").parquet(f"{tmpdir_path}/log")
    schema = "seq long, kind string, item string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_path}/log")
    q = toggles.start_toggle_counter(spark, stream, f"{tmpdir_path}/state", f"{tmpdir_path}/ck")
    q.awaitTermination()
    got = toggles.read_toggle_counter(spark, f"{tmpdir_path}/state").first()
    full = spark.createDataFrame(rows, schema)
    want = toggle.moved_count(toggle.toggle_state(full)).first()
    assert (got.counter, got.n_moved) == (want.counter, want.n_moved)
    assert len([d for d in __import__("os").listdir(f"{tmpdir_path}/state") if d.startswith("batch=")]) == 4

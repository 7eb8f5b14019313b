"""Observed totals equal counts, for one job and over micro-batches."""
import time

import pytest
from pyspark.sql import functions as F

from assetflow.plans.progress import Progress, StreamProgress, rows_seen


def test_totals_equal_a_count_without_a_second_pass(spark, tmpdir_path):
    p = Progress()
    df = spark.range(10_000).withColumn("size", F.col("id") % 7)
    seen = p.watch(df, "listed", bytes=F.sum("size"))
    kept = p.watch(seen.filter("id % 3 = 0"), "kept", largest=F.max("id"))
    kept.write.parquet(f"{tmpdir_path}/out")
    assert p.totals("listed") == {"rows": 10_000, "bytes": sum(i % 7 for i in range(10_000))}
    assert p.totals("kept") == {"rows": 3334, "largest": 9999}
    with pytest.raises(ValueError):
        p.watch(df, "kept")


def test_empty_input(spark):
    p = Progress()
    p.watch(spark.range(0), "none", bytes=F.sum("id")).collect()
    assert p.totals("none") == {"rows": 0, "bytes": None}


def test_rows_seen_counts_every_row(spark):
    df, seen = rows_seen(spark.range(0, 5230, 1, 3).withColumn("x", F.lit("y")), every=100)
    assert df.count() == 5230 and seen.value == 5230


def test_stream_metrics_equal_the_rows(spark, tmpdir_path):
    for k in range(3):
        spark.range(100 * k, 100 * k + 50 + k).coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/in")
    listener = StreamProgress("hashed")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_path}/in")
        q = (stream.observe("hashed", F.count(F.lit(1)).alias("rows")).writeStream.format("parquet").option("path", f"{tmpdir_path}/out")
             .option("checkpointLocation", f"{tmpdir_path}/cp").trigger(availableNow=True).start())
        q.awaitTermination(120)
        for _ in range(50):
            if listener.total() == 153:
                break
            time.sleep(0.2)
        assert listener.total() == 153 == spark.read.parquet(f"{tmpdir_path}/out").count() and len(listener.batches) >= 3
    finally:
        spark.streams.removeListener(listener)

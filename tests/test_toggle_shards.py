"""The sharded toggle counter against the batch view."""
import random

from pyspark.sql import functions as F

from assetflow.operators import toggle
from assetflow.streaming import toggle_shards

SCHEMA = "seq long, kind string, item string"


def test_shards_equal_the_batch_view_and_follow_the_batch(spark, tmpdir_path):
    r = random.Random(8)
    log, seq = [], 0
    for size in (200, 50, 3, 120):
        batch = []
        for _ in range(size):
            seq += 1
            batch.append((seq, "reset", None) if r.random() < 0.03 else (seq, "toggle", f"i{r.randrange(80)}"))
        log += batch
        spark.createDataFrame(batch, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmpdir_path}/log")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmpdir_path}/log")
        toggle_shards.start_shard_counter(spark, stream, f"{tmpdir_path}/out", f"{tmpdir_path}/ck", shards=5).awaitTermination()
        want = toggle.moved_count(toggle.toggle_state(spark.createDataFrame(log, SCHEMA))).first()
        assert tuple(toggle_shards.read_shard_counter(spark, f"{tmpdir_path}/out").first()) == tuple(want)
    per_batch = {x["batch"]: x["n"] for x in spark.read.parquet(f"{tmpdir_path}/out").groupBy("batch").agg(F.sum("n_touched").alias("n")).collect()}
    assert len(per_batch) == 4 and per_batch[2] <= 3 and per_batch[1] <= 50      # items touched, not all items

"""The toggle counter as keyed state: work per micro-batch follows the batch.

Items are dealt to shards by hash; a shard keeps, in the state store, how often each of its items
was toggled, and two running numbers: the counter since the last reset and how many items
are moved now.  A reset is sent to every shard, where it sets the counter to zero and
touches no item.  A batch so reads and writes the items it names, never all of them,
unlike ``toggles.start_toggle_counter``, which rewrites its item table.  The displayed
numbers are the sums over the shards' newest rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SHARDS = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "shard int, seq long, counter long, n_moved long, n_touched long"


class ToggleShard(StatefulProcessor):
    """Counts per item, and the shard's counter and number of moved items."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "n_toggles long")
        self.totals = handle.getValueState("totals", "seq long, counter long, n_moved long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seq, counter, n_moved = self.totals.get() if self.totals.exists() else (-1, 0, 0)
        counts: dict[str, int] = {}
        for at, kind, item in zip(log["seq"].tolist(), log["kind"], log["item"]):
            if kind == "reset":
                counter = 0
            else:
                if item not in counts:
                    counts[item] = self.items.getValue((item,))[0] if self.items.containsKey((item,)) else 0
                counts[item] += 1
                step = 1 if counts[item] % 2 else -1
                counter, n_moved = counter + step, n_moved + step
            seq = max(seq, at)
        for item, n in counts.items():
            self.items.updateValue((item,), (n,))
        self.totals.update((seq, counter, n_moved))
        yield pd.DataFrame({"shard": [key[0]], "seq": [seq], "counter": [counter], "n_moved": [n_moved], "n_touched": [len(counts)]})

    def close(self) -> None:
        pass


def shard_rows(log_stream: DataFrame, shards: int = SHARDS, seq: str = "seq", kind: str = "kind", item: str = "item") -> DataFrame:
    """Streaming ``OUTPUT`` rows, one per shard that a batch touches; rows of other kinds and toggles without an item are left out."""
    log = log_stream.select(F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"), F.col(item).cast("string").alias("item"))
    log = log.filter((F.col("kind") == "reset") | (F.col("kind") == "toggle") & F.col("item").isNotNull())
    own = F.array(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = log.withColumn("shard", F.explode(F.when(F.col("kind") == "reset", every).otherwise(own)))
    return dealt.groupBy("shard").transformWithStateInPandas(ToggleShard(), OUTPUT, "Update", "None")


def start_shard_counter(spark: SparkSession, log_stream: DataFrame, out_dir: str, checkpoint_dir: str,
                        shards: int = SHARDS, available_now: bool = True):
    """Run the shards over a toggle log whose seqs increase from batch to batch; a retried batch overwrites its own folder.

    ``shards`` must stay the same for a checkpoint.
    """
    root = out_dir.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id:09d}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)          # this state API needs it; the query keeps the setting it starts with
    try:
        w = shard_rows(log_stream, shards).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
        return w.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def read_shard_counter(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(counter, n_moved)``: the sums over the newest row of each shard."""
    rows = spark.read.schema(f"{OUTPUT}, batch int").parquet(out_dir)
    newest = rows.groupBy("shard").agg(F.max_by(F.struct("counter", "n_moved"), "batch").alias("t"))
    return newest.agg(F.coalesce(F.sum("t.counter"), F.lit(0)).cast("long").alias("counter"), F.coalesce(F.sum("t.n_moved"), F.lit(0)).cast("long").alias("n_moved"))

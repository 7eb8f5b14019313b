"""Move-toggle state from a stream of toggle/reset events.

``running_toggle_counts`` keeps per-item counts in Spark's state store
(update mode); the moved flag is their parity.  The counter that restarts
at every reset needs the global last reset, which a per-key state cannot
see, so ``start_toggle_counter`` merges each micro-batch into a versioned
per-item table instead (``foreachBatch``); it equals the batch view in
``operators.toggle`` over the same log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_toggle_counts(log_stream: DataFrame, item: str = "item", kind: str = "kind") -> DataFrame:
    """Streaming ``item, n_toggles, moved`` (emit with outputMode('update'))."""
    counts = log_stream.filter(F.col(kind) == "toggle").groupBy(item).agg(F.count(F.lit(1)).alias("n_toggles"))
    return counts.withColumn("moved", F.col("n_toggles") % 2 == 1)


STATE_SCHEMA = "item string, n_toggles long, n_after long, reset_seq long"


def _latest_state(spark, state_dir: str, before_batch: int):
    """(items, last reset seq) of the newest committed batch before ``before_batch``.

    A batch folder counts only once its ``_DONE`` marker exists, so a batch
    that failed half-way is ignored and recomputed.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ids = []
    if fs.exists(root):
        for st in fs.listStatus(root):
            name = st.getPath().getName()
            if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_DONE")):
                bid = int(name.split("=", 1)[1])
                if bid < before_batch:
                    ids.append(bid)
    if not ids:
        return spark.createDataFrame([], STATE_SCHEMA), -1
    folder = f"{state_dir.rstrip('/')}/batch={max(ids):09d}"
    items = spark.read.schema(STATE_SCHEMA).parquet(f"{folder}/items")
    meta = spark.read.schema("last_reset long").parquet(f"{folder}/meta").first()
    return items, int(meta.last_reset)


def merge_toggle_batch(state, last_reset: int, batch, seq: str = "seq", kind: str = "kind", item: str = "item"):
    """New per-item state after one batch of the log (seqs increase across batches).

    ``n_after`` counts an item's toggles after the last reset; a reset in
    this batch zeroes every item's ``n_after`` (lazily: an item whose
    ``reset_seq`` is older than the current reset has ``n_after`` 0).
    """
    r = batch.filter(F.col(kind) == "reset").agg(F.max(seq)).first()[0]
    new_reset = max(last_reset, r) if r is not None else last_reset
    per = batch.filter(F.col(kind) == "toggle").groupBy(item).agg(
        F.count(F.lit(1)).alias("n_b"), F.count(F.when(F.col(seq) > new_reset, 1)).alias("n_b_after"))
    merged = state.join(per, item, "full_outer")
    old_after = F.when(F.col("reset_seq") == new_reset, F.col("n_after")).otherwise(F.lit(0))
    out = merged.select(
        item,
        (F.coalesce(F.col("n_toggles"), F.lit(0)) + F.coalesce(F.col("n_b"), F.lit(0))).cast("long").alias("n_toggles"),
        (F.coalesce(old_after, F.lit(0)) + F.coalesce(F.col("n_b_after"), F.lit(0))).cast("long").alias("n_after"),
        F.lit(new_reset).cast("long").alias("reset_seq"))
    return out, new_reset


def counter_view(state) -> DataFrame:
    """Per item: moved flag and its contribution to the counter since the last reset."""
    # every row of a committed state carries the same reset_seq (the merge sets it)
    n_after = F.col("n_after")
    before = F.col("n_toggles") - F.col("_after")
    delta = F.when(F.col("_after") % 2 == 0, F.lit(0)).when(before % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return (state.withColumn("_after", n_after)
            .select("item", "n_toggles", (F.col("n_toggles") % 2 == 1).alias("moved"), delta.cast("long").alias("delta")))


def start_toggle_counter(spark, log_stream: DataFrame, state_dir: str, checkpoint_dir: str,
                         available_now: bool = True):
    """Stream the toggle log into a versioned per-item state (one folder per batch id).

    A retried batch recomputes from the previous committed version and
    overwrites its own folder, so the state never double counts.  Every
    batch rewrites the item table (a merge), so its cost grows with the
    number of items, not with the history.
    """
    root = state_dir.rstrip("/")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        state, last_reset = _latest_state(s, root, batch_id)
        new_state, new_reset = merge_toggle_batch(state, last_reset, batch)
        folder = f"{root}/batch={batch_id:09d}"
        new_state.write.mode("overwrite").parquet(f"{folder}/items")
        s.createDataFrame([(int(new_reset),)], "last_reset long").write.mode("overwrite").parquet(f"{folder}/meta")
        s.createDataFrame([], "x int").write.mode("overwrite").parquet(f"{folder}/_DONE")

    w = log_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_toggle_counter(spark, state_dir: str):
    """Current (counter, n_moved) from the newest committed state."""
    state, _ = _latest_state(spark, state_dir.rstrip("/"), 1 << 62)
    v = counter_view(state)
    return v.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("long").alias("counter"),
                 F.count(F.when(F.col("moved"), 1)).alias("n_moved"))

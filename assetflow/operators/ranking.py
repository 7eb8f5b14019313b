"""Row numbers inside groups that never put a whole group on one task.

``row_number().over(partitionBy(g))`` sends every row of a group to one task;
one label or hash holding a third of the data would then be sorted by a
single core.  Here the rows are range-partitioned on (group, order) instead,
so a hot group is spread over many contiguous partitions:

1. range partition on (group keys, order keys), tag rows with the partition id;
2. write a scratch table, so partition ids are pinned (recomputation after an
   executor loss reads the table, not a fresh sample) and later passes read only
   the columns they need;
3. number rows inside each (partition, group) chunk;
4. a group that spans partitions is the first or last group of every
   partition it touches, so at most 2 x partitions chunks need an offset;
   those offsets come from a running sum over that tiny table and are
   broadcast (size bound: 2 rows per partition).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.session import scratch_table


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _null_safe_eq(left: DataFrame, right: DataFrame, cols) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def rank_within_groups(df: DataFrame, group_cols, order_cols, rank_col: str = "rank",
                       num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number`` of each row inside its group, skew-safe.

    ``order_cols`` (names or sort Columns) must make a total order inside a
    group, e.g. end with a unique path.  An empty ``group_cols`` numbers the
    whole frame.  The partition ids come from a sampled range partitioning, so
    they are written before anything is derived from them: rows, chunk
    counts and bounds all read the same table.
    """
    spark = df.sparkSession
    gcols = list(group_cols)
    work = df
    if not gcols:
        work = work.withColumn("_g", F.lit(0))
        gcols = ["_g"]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    orders = [_as_col(o) for o in order_cols]
    ranged = work.repartitionByRange(n, *[F.col(g) for g in gcols], *orders) \
        .withColumn("_pid", F.spark_partition_id())
    ranged = scratch_table(ranged, "ranked")

    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *gcols).orderBy(*orders)))

    key = F.struct(*[F.col(g) for g in gcols])
    chunks = ranged.groupBy("_pid", *gcols).agg(F.count(F.lit(1)).alias("_n"))
    bounds = ranged.groupBy("_pid").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    edge = (chunks.join(F.broadcast(bounds), "_pid")
            .filter(key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last"))))
    before = Window.partitionBy(*gcols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.select(
        F.col("_pid").alias("_opid"), *[F.col(g).alias(f"_o_{g}") for g in gcols],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))

    cond = (local["_pid"] == offsets["_opid"]) & reduce(
        lambda a, b: a & b, [local[g].eqNullSafe(offsets[f"_o_{g}"]) for g in gcols])
    out = (local.join(F.broadcast(offsets), cond, "left")
           .withColumn(rank_col, (F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))).cast("long")))
    drop = ["_pid", "_local", "_off", "_opid"] + [f"_o_{g}" for g in gcols]
    if gcols == ["_g"]:
        drop.append("_g")
    return out.drop(*drop)

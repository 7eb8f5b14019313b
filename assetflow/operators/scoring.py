"""Detections -> weighted score, class bitmask and priority label.

The class dimension is caller configuration (ordered rows of class, weight
and label), small and static, so it is broadcast for the class lookup and
compiled into a ``CASE`` chain for the label: no join with the assets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEUTRAL_LABEL = "00-neutral"  # fixed value: label of an asset with no class bit set
FACE_PREFIX = "face-"          # fixed value: prefix when the face bit is set


@dataclass(frozen=True)
class ClassDimension:
    """Ordered (class, weight, group label) rows plus the face bit."""
    rows: tuple  # ((class, weight, label), ...) in priority order
    face_bit: int = 4

    def frame(self, spark: SparkSession) -> DataFrame:
        data = [(i + 1, c, int(w), k) for i, (c, w, k) in enumerate(self.rows)]
        return spark.createDataFrame(data, "ordinal int, class string, weight long, group_key string")


def weighted_detections(det: DataFrame, dim: ClassDimension) -> DataFrame:
    """Attach each detection's class weight; an unknown class is an error."""
    weights = F.broadcast(dim.frame(det.sparkSession).select("class", "weight"))
    j = det.join(weights, "class", "left")
    checked = F.when(F.col("weight").isNull(),
                     F.raise_error(F.concat(F.lit("unknown class: "), F.col("class")))) \
        .otherwise(F.col("weight"))
    return j.withColumn("weight", checked.cast("long"))


def score_assets(assets: DataFrame, det: DataFrame, dim: ClassDimension,
                 key: str = "asset_id") -> DataFrame:
    """Per asset: ``score = sum((1 + s) * weight)``, ``mask = bit_or(weight)``.

    Partial aggregation happens before the shuffle; assets without any
    detection get score 0 and mask 0.
    """
    w = weighted_detections(det, dim)
    per = w.groupBy(key).agg(
        F.sum((F.lit(1.0) + F.col("score")) * F.col("weight")).alias("score"),
        F.bit_or("weight").alias("mask"))
    return (assets.join(per, key, "left")
            .withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
            .withColumn("mask", F.coalesce(F.col("mask"), F.lit(0)).cast("long")))


def label_of(mask: Column, dim: ClassDimension) -> Column:
    """``face-`` prefix when the face bit is set, then the first dimension row
    (in order) whose weight bit is in the mask; ``00-neutral`` when none."""
    chain = None
    for _c, w, k in dim.rows:
        cond = (mask.bitwiseAND(F.lit(int(w))) != 0)
        chain = F.when(cond, F.lit(k)) if chain is None else chain.when(cond, F.lit(k))
    base = chain.otherwise(F.lit("")) if chain is not None else F.lit("")
    prefix = F.when(mask.bitwiseAND(F.lit(dim.face_bit)) != 0, F.lit(FACE_PREFIX)).otherwise(F.lit(""))
    lab = F.concat(prefix, base)
    return F.when(lab == "", F.lit(NEUTRAL_LABEL)).otherwise(lab)


def label_assets(scored: DataFrame, dim: ClassDimension) -> DataFrame:
    return scored.withColumn("label", label_of(F.col("mask"), dim))


def predict_missing(pending: DataFrame, predict_batch, schema: str) -> DataFrame:
    """Run a caller's batch detector over the assets missing from the cache.

    ``predict_batch(pandas.DataFrame) -> pandas.DataFrame`` sees Arrow batches
    of pending rows (``mapInPandas``); only misses cross into Python.
    """
    def run(batches):
        for pdf in batches:
            yield predict_batch(pdf)
    return pending.mapInPandas(run, schema)


def best_per_group(df: DataFrame, group_cols, order) -> DataFrame:
    """The first row of each group in ``order`` (ascending Columns), via a
    partially aggregated ``min`` over a sort struct: no group is collected."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    best = F.min(F.struct(key.alias("key"), F.struct(*df.columns).alias("row"))).alias("_best")
    return df.groupBy(*group_cols).agg(best).select(*group_cols, *[
        F.col(f"_best.row.{c}").alias(c) for c in df.columns if c not in group_cols])

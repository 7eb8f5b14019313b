"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every assetflow job wants.  Shuffle partitions are sized by the
# caller; AQE coalesces small partitions and splits skewed join partitions.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "assetflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with assetflow defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the local
    master is only for tests and the benchmark.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    # the checkpoint folder is resolved lazily by the operators that need one
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when none is set.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    always wins.  Only a local session without one (tests) gets a fresh
    private folder; on a cluster a machine-local folder would not survive an
    executor loss, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (needed by skew-safe ranking)")
        configured = tempfile.mkdtemp(prefix="assetflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """The name of a fresh folder below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written below the checkpoint folder and read back: lineage is cut and Spark knows its size."""
    path = scratch_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
               min_partitions: int = 200) -> dict:
    """Spill-aware sizing for a job reading ``input_bytes``.

    Scan splits and shuffle partitions aim at ``target_partition_bytes`` so a
    task's data fits executor memory; AQE starts from that many shuffle
    partitions and coalesces small ones at runtime, and splits skewed join
    partitions.  Example: 100 TB -> ~400k partitions of 256 MiB.
    """
    n = max(min_partitions, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }

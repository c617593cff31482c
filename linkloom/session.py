"""Session helpers: scale-oriented defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning settings that matter at 100 TB: AQE coalesces small
# shuffle partitions, splits skewed join partitions (a domain may hold a third
# of all rows) and turns sort-merge joins into broadcast joins only when the
# *measured* size of a shuffle stage is below the threshold.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # sort-merge -> shuffled hash join at runtime, only when every measured
    # build-side partition is below this size (skips both sorts)
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "linkloom",
              extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """Local/test session.  In local mode the driver JVM is the executor, so
    its heap is the whole engine's memory (Spark's default is 1 GB)."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SCALE_CONF)
    if master.startswith("local"):
        conf["spark.driver.memory"] = driver_memory or os.environ.get("LINKLOOM_DRIVER_MEMORY", "12g")
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_scale_conf(spark: SparkSession) -> None:
    """Set the AQE/skew settings on an existing session (runtime-modifiable only)."""
    for k, v in SCALE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    The setting must exist: a machine-local folder would not survive executor
    loss.  Only ``get_spark`` on a local master (tests, bench) sets one itself.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) on a cluster")
        configured = tempfile.mkdtemp(prefix="linkloom-ckpt-")  # one process: its folder is everybody's
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

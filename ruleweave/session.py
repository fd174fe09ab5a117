"""Session helpers: building a local session for tests/bench and finding the
shared folder used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


# Settings for a large cluster (documented, not applied here): size shuffle
# partitions to ~128-256 MB each after the largest shuffle (or let AQE coalesce
# from a high start), keep AQE skew-join splitting on (a customer or rule
# holding a third of all rows splits into many tasks), and read Parquet in
# 256 MB splits.
CLUSTER_HINTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ruleweave") -> SparkSession:
    """A local session configured like the tests and bench expect.

    AQE is on (runtime coalescing, skew-join splitting, and SMJ → BHJ
    conversion once a shuffle side is measured small).  The UI is off.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is read as is; without
    it an error is raised, as other nodes do not see a folder of this machine.
    Only on a local master a fresh folder is made and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if conf_dir:
        if not sc_dir:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    local_dir = tempfile.mkdtemp(prefix="ruleweave-ckpt-")
    spark.sparkContext.setCheckpointDir(local_dir)
    try:  # mirror it in the conf when the deployment allows runtime changes
        spark.conf.set("spark.checkpoint.dir", local_dir)
    except Exception:  # noqa: BLE001
        pass
    return local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet to the shared folder and
    reading it back.  Survives executor loss (unlike a local checkpoint):
    the files live on shared storage, and re-reading is a plain scan.
    ``partition_by`` writes one folder per value, which a filter on it then reads alone."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether the (shared) path exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def default_buckets(df: DataFrame, floor: int = 256) -> int:
    """Range buckets for bucketed ranks/quantiles/AUC: 4 × the cluster's
    shuffle partitions (at least ``floor``), so a hot group is spread over
    about as many tasks as the cluster runs for a shuffle."""
    try:
        p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001
        p = 200
    return max(int(floor), 4 * p)

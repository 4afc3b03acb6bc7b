"""Session helpers: a local session for tests/bench and the shared scratch folder.

On a cluster the session is supplied by the caller; nothing here changes its
configuration. Scratch output (CSV round trips, saved models, checkpoints)
always goes under the folder named by ``spark.checkpoint.dir``, which a
cluster points at shared storage. Only a local-mode session without that
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "panelcast") -> SparkSession:
    """Session for tests and the local benchmark (UI off, AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Reads the folder already set on the SparkContext, or ``spark.checkpoint.dir``.
    Without either, a session in local mode gets a temporary folder; on a
    cluster that is an error, because a machine-local path would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage")
        folder = tempfile.mkdtemp(prefix="panelcast-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but the re-read plan is a plain
    parquet scan: columns are pruned, filters pushed down, and Catalyst does
    not carry the original plan's constraints along (``checkpoint()`` does,
    which is costly on plans with many derived columns).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Session helpers: build a session for local runs and find a reliable
checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kanaforge") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, Arrow on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the checkpoint directory the cluster names.

    ``spark.checkpoint.dir`` (or an earlier ``setCheckpointDir``) wins. Only a
    local-mode session without one gets a fresh scratch folder; on a cluster a
    machine-local folder would not survive the loss of an executor, so we refuse.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared (HDFS/S3/...) folder for checkpoints"
        )
    path = tempfile.mkdtemp(prefix="kanaforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint directory the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Shuffle files go as soon as the statement that wrote them ends, not at the driver's next collection of garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame) -> DataFrame:
    """The frame written as Parquet below the checkpoint directory and read back, for
    narrow tables that several branches of a plan read. What it shuffled is dropped."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "table")
    was = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if was is None else spark.conf.set(DROP_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)

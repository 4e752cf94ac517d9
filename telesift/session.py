"""Session helpers: defaults for stand-alone runs and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_private: dict[str, str] = {}  # of local sessions that name no folder, as in tests


def local_session(app: str = "telesift", cpus: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own. Its scratch folder is private unless one is configured."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TELESIFT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if not SparkConf().contains(CHECKPOINT_CONF):
        builder = builder.config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="telesift-"))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names for checkpoints; intermediate tables lie there too."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root and spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        root = _private[app] = _private.get(app) or tempfile.mkdtemp(prefix="telesift-")
    if not root:
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/telesift/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives the loss of an executor)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_path(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once to the shared folder and go on from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

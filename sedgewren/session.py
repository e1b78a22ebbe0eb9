"""Session helpers: a tuned local session and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, memory: str = "12g", partitions: int = 8, name: str = "sedgewren") -> SparkSession:
    """Single-JVM session for tests and benches; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="sedgewren-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """This run's folder below ``spark.checkpoint.dir``, which all executors share.

    Without the setting a temporary folder is made in local mode only, where driver and executors are one machine; on a cluster
    that is an error. The folder is deleted when the session's JVM ends, or by ``release``.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sedgewren-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    run = f"{where.rstrip('/')}/sedgewren-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(run)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return run


def release(spark: SparkSession) -> None:
    """Delete all tables that this run has written; frames that still read them can't be used afterwards."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast only if it is counted to have at most ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """A frame in fewer pieces than there are cores is dealt out to all of them before costly work; others stay as they are.

    For scans and narrow plans over them: counting the pieces of a plan with a shuffle would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

"""Session helpers: the shared folder, lineage cuts and separate name spaces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is only used for a local master, where driver and executors are one process.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_CONF} to a folder shared by the cluster.")
    folder = tempfile.mkdtemp(prefix="geoloom-")
    context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and stores it reliably, so that later uses neither repeat nor lose it."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that are written and read back.

    All paths of an application lie in one folder, which goes when the application ends.
    """
    context = spark.sparkContext
    root = f"{shared_dir(spark).rstrip('/')}/geoloom-{context.applicationId}"
    if root not in _ROOTS:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def store(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back, with a folder per value of ``by``."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def isolated_session(spark: SparkSession) -> SparkSession:
    """A session with its own temporary views and the same context and SQL settings."""
    other = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        other.conf.set(key, spark.conf.get(key))
    return other

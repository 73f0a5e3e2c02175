"""Session helpers: sensible defaults and lineage cutting through the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spanlytics", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and continue from there.

    The files survive the loss of executors and keep iterative plans short; columns take a fraction of the
    disk that serialized rows would. They go when the application ends.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(target)


def task_count(spark: SparkSession) -> int:
    """Tasks of a stage that computes much from little data, which adaptive coalescing by size would put in one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the cluster, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_spanlytics_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="spark-"), "spanlytics_code"), "zip", root, "spanlytics"
    )
    sc.addPyFile(archive)
    sc._spanlytics_shipped = True

"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Start wide and let adaptive execution merge small shuffle partitions, so one
    # setting serves both a laptop and a cluster.
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Scaled datasets go to a handful of folders at once, without sorting rows by folder.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "tarmac", **settings: str) -> SparkSession:
    """Session with the library's defaults; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    chosen = {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}
    for name, value in chosen.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor can reach, deleted when the application ends.

    It lies under ``spark.checkpoint.dir``. Only a session on one machine without that
    setting falls back to a temporary folder, because there driver and executors are one.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        shared = tempfile.gettempdir()
    folder = f"{shared.rstrip('/')}/tarmac-{label}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder + "/data"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the scratch folder and read again.

    Cuts the lineage with files that every executor reaches, so a lost executor costs its
    running tasks only.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Run logs: one row per timed run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schema import RUN_LOG_FILE


def read_runs(spark: SparkSession, path: str, env: str) -> DataFrame:
    """A run log in the layout ``10%,3.1,Hive,8`` as ``analysis, tech, pct, env, seconds``.

    Repeated runs are told apart by ``repeat``, the start of the run; logs without a start
    number their rows as they are read.
    """
    log = spark.read.schema(RUN_LOG_FILE).option("header", True).csv(path)
    return log.select(
        F.col("Analisi").alias("analysis"),
        F.col("Tecnologia").alias("tech"),
        F.replace(F.col("Percentuale"), F.lit("%"), F.lit("")).cast("int").alias("pct"),
        F.lit(env).alias("env"),
        F.col("Tempo_Secondi").alias("seconds"),
        F.coalesce("Inizio", F.monotonically_increasing_id()).alias("repeat"),
    )


# Rows of one file of a compacted log.
COMPACTED = 1_000_000


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and a maker of paths in it."""
    context = spark.sparkContext
    make = context._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(context._jsc.hadoopConfiguration()), make


def _publish(rows: DataFrame, path: str, label: str) -> None:
    """Adds the rows to the log as files named after ``label``.

    They are written to a folder of their own, which readers skip, and each file enters the log
    by one rename, so writers do not meet.
    """
    store, make = _files(rows.sparkSession, path)
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(staging)
    try:
        written = sorted(f.getPath().getName() for f in store.listStatus(make(staging)))
        for i, name in enumerate(n for n in written if n.startswith("part-")):
            if not store.rename(make(f"{staging}/{name}"), make(f"{path}/{label}-{i:05d}.csv")):
                raise OSError(f"{staging}/{name} could not be moved into the log")
    finally:
        store.delete(make(staging), True)


def append_run(
    spark: SparkSession, path: str, pct: int, analysis: str, tech: str, seconds: float
) -> None:
    """Add one run to the log at ``path``; any number of runs may be added at once."""
    started = time.time_ns() // 1000
    row = spark.createDataFrame(
        [(f"{pct}%", analysis, tech, float(seconds), started)], RUN_LOG_FILE
    )
    _publish(row.coalesce(1), path, f"run-{started}-{uuid.uuid4().hex}")


def write_runs(runs: DataFrame, path: str) -> None:
    """Add many runs to the log at ``path``, with ``repeat`` as their order."""
    rows = runs.select(
        F.concat(F.col("pct").cast("string"), F.lit("%")).alias("Percentuale"),
        F.col("analysis").alias("Analisi"),
        F.col("tech").alias("Tecnologia"),
        F.col("seconds").cast("double").alias("Tempo_Secondi"),
        F.col("repeat").cast("bigint").alias("Inizio"),
    )
    _publish(rows, path, f"runs-{uuid.uuid4().hex}")


def compact_runs(spark: SparkSession, path: str, rows_per_file: int = COMPACTED) -> None:
    """Rewrites the log in few files, in the order of the runs.

    Runs that are added meanwhile stay as they are. The old files wait in a folder that readers
    skip until all new ones have entered the log; if that is interrupted, the next call takes
    the new ones out and puts the old ones back. The log is not to be read meanwhile.
    """
    store, make = _files(spark, path)

    def names(folder: str = "") -> list[str]:
        return sorted(f.getPath().getName() for f in store.listStatus(make(path + folder)))

    def move(source: str, target: str) -> None:
        if not store.rename(make(path + source), make(path + target)):
            raise OSError(f"{path}{source} could not be moved")

    for old in [n for n in names() if n.startswith("_old-")]:
        label = old.removeprefix("_old-")
        if f"_new-{label}" in names():
            for name in [n for n in names() if n.startswith(f"all-{label}-")]:
                store.delete(make(f"{path}/{name}"), False)
            for name in names(f"/{old}"):
                move(f"/{old}/{name}", f"/{name}")
            store.delete(make(f"{path}/_new-{label}"), True)
        store.delete(make(f"{path}/{old}"), True)
    merged = [n for n in names() if n[0] not in "_."]
    if not merged:
        return
    label = uuid.uuid4().hex
    log = spark.read.schema(RUN_LOG_FILE).option("header", True)
    rows = log.csv([f"{path}/{n}" for n in merged])
    files = max(1, -(-rows.count() // rows_per_file))
    order = ["Inizio", "Percentuale", "Analisi", "Tecnologia", "Tempo_Secondi"]
    ranges = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranges.write.option("header", True).csv(f"{path}/_new-{label}")
    new = [n for n in names(f"/_new-{label}") if n.startswith("part-")]
    store.mkdirs(make(f"{path}/_old-{label}"))
    for name in merged:
        move(f"/{name}", f"/_old-{label}/{name}")
    for i, name in enumerate(new):
        move(f"/_new-{label}/{name}", f"/all-{label}-{i:05d}.csv")
    # From here on the new files count.
    store.delete(make(f"{path}/_new-{label}"), True)
    store.delete(make(f"{path}/_old-{label}"), True)


def timed(
    spark: SparkSession, log: str, pct: int, analysis: str, tech: str, job: Callable[[], object]
) -> float:
    """Run ``job``, add its wall-clock seconds to the log and return them."""
    start = time.monotonic()
    job()
    seconds = round(time.monotonic() - start, 3)
    append_run(spark, log, pct, analysis, tech, seconds)
    return seconds

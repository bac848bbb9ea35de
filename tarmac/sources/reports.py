"""Reports and scaled datasets on disk."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import as_doubles
from tarmac.operators.ranking import top_n
from tarmac.operators.reconcile import SUMMARY_COLUMNS, missing_input, reconcile
from tarmac.operators.sample import scaled
from tarmac.schema import SAMPLE_SEED, SCALES

QUOTED = "cause_maggiori"


def _unquoted(df: DataFrame) -> DataFrame:
    """The label carries its own double quotes; a CSV writer adds them itself."""
    if QUOTED not in df.columns:
        return df
    return df.withColumn(QUOTED, F.btrim(F.col(QUOTED), F.lit('"')))


def _save(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_report(
    df: DataFrame,
    path: str,
    order: Sequence[str],
    fmt: str = "csv",
    plain_numbers: bool = False,
) -> None:
    """The whole report, globally ordered over its part files, with a header.

    Means and rates print with fixed decimals; ``plain_numbers`` drops trailing zeros.
    """
    if fmt == "csv":
        df = _unquoted(as_doubles(df) if plain_numbers else df)
    _save(df.orderBy(*order), path, fmt)


def read_report(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A report written before, with its declared column types."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    if QUOTED not in df.columns:
        return df
    return df.withColumn(QUOTED, F.concat(F.lit('"'), F.col(QUOTED), F.lit('"')))


def read_ordered(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    order: Sequence[str],
    place: str = "place",
) -> DataFrame:
    """A report written before, with the place of every row in its files' order from 1.

    The files hold ranges of the order, so only their first keys and row counts are compared;
    rows are numbered inside their own file. A file whose keys reach into those of the next
    one is refused, as the report was not written in this order.
    """
    rows = read_report(spark, path, schema).withColumn("_file", F.col("_metadata.file_path"))
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    parts = (
        rows.groupBy("_file")
        .agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
        .orderBy("first")
        .collect()
    )
    before, starts, last = 0, [], None
    for part in parts:
        if last is not None and [(v is not None, v) for v in part["first"]] < [(v is not None, v) for v in last]:
            raise ValueError(f"the files of {path} do not follow each other by {list(order)}")
        starts.append((part["_file"], before))
        before, last = before + part.n, part["last"]
    starts = spark.createDataFrame(starts, "_file string, _before bigint")
    inside = F.row_number().over(Window.partitionBy("_file").orderBy(*[F.col(f"`{c}`") for c in order]))
    joined = rows.join(starts, "_file").withColumn(place, F.col("_before") + inside)
    return joined.drop("_file", "_before")


def snapshot(
    spark: SparkSession,
    path: str,
    target: str,
    schema: T.StructType,
    order: Sequence[str],
    n: int = 10,
) -> None:
    """The first rows of a stored report, read back instead of computed again."""
    report = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    _save(top_n(report, order, n), target, "csv")


def write_scales(
    df: DataFrame,
    path: str,
    scales: Sequence[float] = SCALES,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    formats: Sequence[str] = ("parquet", "csv"),
) -> None:
    """Every scaled dataset under ``<path>/<format>/scale=<percent>``, one pass per format."""
    spread = scaled(df, scales, key, seed)
    for fmt in formats:
        writer = spread.write.mode("overwrite").partitionBy("scale")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{path}/{fmt}")


def reconcile_files(
    spark: SparkSession,
    jobs: Sequence[tuple[str, str, str, T.StructType, Sequence[str]]],
    fmt: str = "csv",
) -> DataFrame:
    """Summary of several stored report pairs, ``(job, path_a, path_b, schema, keys)`` each.

    A pair with a missing file gets a row saying so.
    """
    rows = []
    for job, path_a, path_b, schema, keys in jobs:
        try:
            a, b = (read_report(spark, p, schema, fmt) for p in (path_a, path_b))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows.append(missing_input(spark, job))
        else:
            rows.append(reconcile(a, b, keys, job).select(*SUMMARY_COLUMNS))
    return reduce(DataFrame.unionByName, rows)

"""Pieces that several operators on training text share."""

from __future__ import annotations

import os
import shutil
import string
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tarmac.session import stored

__all__ = ["WORD", "ascii_lower", "every", "let", "map_arrow", "map_pandas", "quoted", "remainder", "stored", "table", "words"]

# A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tarmac_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.realpath(tempfile.mkdtemp(prefix="tarmac-")) + "/tarmac-package"
    context.addPyFile(shutil.make_archive(target, "zip", root, "tarmac"))
    context._tarmac_shipped = True


def _mapped(df: DataFrame, how: str, run: Callable, schema: StructType | str) -> DataFrame:
    """``df`` through a function on batches, which see plain names in place of dotted ones."""
    _shipped(df.sparkSession)
    plain = {c: f"_dotted{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
    if not plain:
        return getattr(df, how)(run, schema)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    fields = [StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in schema]
    renamed = df.toDF(*[plain.get(c, c) for c in df.columns])
    return getattr(renamed, how)(run, StructType(fields)).toDF(*schema.names)


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand on every worker."""
    return _mapped(df, "mapInArrow", run, schema)


def map_pandas(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInPandas`` with this package at hand on every worker."""
    return _mapped(df, "mapInPandas", run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def quoted(name: str) -> str:
    """A column name as an expression, whatever signs it holds."""
    return f"`{name.replace('`', '``')}`"


def every(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, whatever signs their names hold."""
    return [F.col(quoted(c)) for c in docs.columns]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    every = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(every)


def words(text: Column, pattern: str = WORD) -> Column:
    """The matches of ``pattern`` in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor

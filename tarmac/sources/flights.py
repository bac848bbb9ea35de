"""Flight records from delimited text or Parquet.

Reading yields two frames over the same scan: good rows with the declared types, and
rejected rows with the reasons, so nothing disappears silently.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import keep_unless, nan_to_null
from tarmac.schema import CAUSE_COLUMNS, FLIGHT_COLUMNS, RAW_EXTRA_COLUMNS

KNOWN = {**RAW_EXTRA_COLUMNS, **FLIGHT_COLUMNS}
CAUSES = tuple(CAUSE_COLUMNS.values())
RECORD, REASONS = "_record", "_reasons"


class Loaded(NamedTuple):
    """Good rows, rejected ones and the columns found.

    ``lines`` is what both come from, if it was text: every line with its typed cells, the
    ``_record`` as it stands in the file and the ``_reasons`` to reject it.
    """

    good: DataFrame
    rejected: DataFrame
    columns: list[str]
    lines: DataFrame | None = None

    @classmethod
    def of_lines(cls, lines: DataFrame, columns: list[str]) -> Loaded:
        accepted = F.size(REASONS) == 0
        return cls(
            lines.where(accepted).drop(RECORD, REASONS),
            lines.where(~accepted).select(F.col(RECORD).alias("record"), F.col(REASONS).alias("reasons")),
            columns,
            lines,
        )


def _flag_ok() -> Column:
    return F.col("cancelled").isin(0, 1)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    null_text: str = "",
    strict_dates: bool = False,
    seen: Observation | None = None,
) -> Loaded:
    """Delimited text with a header line, columns matched by name.

    Only the header is read to learn the names; types are declared, never inferred. Every line
    is parsed once into text cells, and every cell converted once; a cell that has text but no
    value is the reason to reject its line.
    A row is rejected when it has the wrong number of fields, holds text in a number or
    date, or has a cancellation flag other than 0 and 1. Unreadable cause minutes become
    NULL and are left for cleaning. Blank lines and repeated headers are skipped; a line that
    begins like a header and is another one stops the job. Empty
    cells, ``NaN`` and ``null_text`` are missing values. With ``strict_dates`` an
    unreadable date stops the job instead. ``seen`` counts the ``refused`` lines of the first
    job that reads them.
    """
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    lines = _typed_lines(spark.read.text(path), names, sep, null_text, strict_dates)
    if seen:
        lines = lines.observe(seen, F.count_if(F.size(REASONS) > 0).alias("refused"))
    return Loaded.of_lines(lines, names)


def _typed_lines(
    lines: DataFrame, names: list[str], sep: str, null_text: str, strict_dates: bool
) -> DataFrame:
    """The known columns with their values, the line, and the reasons to reject it.

    Cells and reasons come from generators of one row each, so that the optimizer moves no
    filter below them, which would parse lines and convert cells once more.
    """
    cells, wrong = [f"_c{i}" for i in range(len(names))], "_wrong"
    options = {"sep": sep, "columnNameOfCorruptRecord": wrong, "nullValue": null_text}
    options |= {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    layout = ", ".join(f"{c} string" for c in [*cells, wrong])
    parsed = lines.where(F.trim("value") != "").select(
        F.col("value").alias(RECORD), F.inline(F.array(F.from_csv("value", layout, options)))
    )
    first = F.col(cells[0])
    header = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(n) for c, n in zip(cells, names)])
    other = F.raise_error(F.concat(F.lit("a file has another header: "), F.col(RECORD)))
    data = F.when(first.isin(names) & ~header, other.cast("boolean")).otherwise(~header)

    values, unreadable = {}, {}
    for cell, name in zip(cells, names):
        if name not in KNOWN:
            continue
        kind = KNOWN[name]
        if isinstance(kind, T.TimestampType):
            convert = F.to_timestamp if strict_dates else F.try_to_timestamp
            values[name] = convert(cell)
        elif name in CAUSES or isinstance(kind, (T.DoubleType, T.LongType)):
            # Whole numbers may be written ``12.0``.
            values[name] = F.col(cell).try_cast("double")
        else:
            values[name] = F.col(cell)
        if not isinstance(kind, T.StringType) and name not in CAUSES and not (
            strict_dates and isinstance(kind, T.TimestampType)
        ):
            unreadable[name] = F.col(cell).isNotNull() & F.col(name).isNull()
    kept = [F.col(RECORD), F.col(wrong), *[v.alias(n) for n, v in values.items()], *map(F.col, cells)]
    converted = parsed.where(data).select(*kept)

    short = F.col(wrong).isNotNull()
    reasons = [F.when(short, F.lit("width"))]
    reasons += [F.when(bad, F.lit(name)) for name, bad in unreadable.items()]
    if "cancelled" in values:
        present = ~short | F.col(cells[names.index("cancelled")]).isNotNull()
        odd = present & ~F.coalesce(_flag_ok(), F.lit(False))
        reasons.append(F.when(odd, F.lit("flag")))
    found = F.struct(F.array_compact(F.array(*reasons)).alias(REASONS))
    numbers = (T.DoubleType, T.LongType)
    final = [
        (nan_to_null(F.col(n)).try_cast(KNOWN[n]) if isinstance(KNOWN[n], numbers) else F.col(n)).alias(n)
        for n in values
    ]
    judged = converted.select(RECORD, *values, F.inline(F.array(found)))
    return judged.select(*final, RECORD, REASONS)


def split_flags(df: DataFrame) -> Loaded:
    """Rows whose cancellation flag is 0 or 1, and the others."""
    return Loaded(df.where(_flag_ok()), df.where(keep_unless(_flag_ok())), df.columns)


def read_parquet(spark: SparkSession, path: str, seen: Observation | None = None) -> Loaded:
    """Flights kept as Parquet: the preferred input, only the used columns are read.

    ``seen`` counts the ``refused`` rows of the first job that reads them.
    """
    df = spark.read.parquet(path)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    df = df.withColumns({c: nan_to_null(F.col(c)) for c in floats})
    if seen:
        df = df.observe(seen, F.count_if(keep_unless(_flag_ok())).alias("refused"))
    return split_flags(df)


def declare_flights(
    spark: SparkSession, path: str, table: str = "flights", source: str = "parquet"
) -> DataFrame:
    """(Re)define a table over existing files, for use from SQL.

    ``table`` may carry a database, which is created if it does not exist. Dropping the
    old definition leaves its files alone, as the table is external. Columns of text files
    are taken in the order of their header, and a file with another header is refused.
    """
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    options, names = {}, list(FLIGHT_COLUMNS)
    if source == "csv":
        options = {"header": "true", "enforceSchema": "false"}
        names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, KNOWN.get(n, T.StringType())) for n in names])
    return spark.catalog.createTable(table, path=path, source=source, schema=schema, **options)

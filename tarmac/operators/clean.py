"""Row cleaning. Every step is a filter or projection, so none of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tarmac.functions import keep_unless, nan_to_null, number_or_zero
from tarmac.schema import (
    CAUSE_COLUMNS,
    DELAY_CEILING,
    DELAY_COLUMNS,
    DELAY_FLOOR,
    FLIGHT_COLUMNS,
)


def corrupt(
    delays: Sequence[str] = DELAY_COLUMNS, flags: Sequence[str] = ("cancelled", "diverted")
) -> Column:
    """A regular row (all flags 0) that nevertheless lacks one of its delays."""
    regular = reduce(and_, [F.col(f) == 0 for f in flags])
    missing = reduce(or_, [nan_to_null(F.col(d).cast("double")).isNull() for d in delays])
    return regular & missing


def outlier(
    low: float = DELAY_FLOOR,
    high: float = DELAY_CEILING,
    delays: Sequence[str] = DELAY_COLUMNS,
) -> Column:
    """Some delay lies outside [low, high]; unknown delays are never outliers."""
    values = [nan_to_null(F.col(d).cast("double")) for d in delays]
    return reduce(or_, [(v < low) | (v > high) for v in values])


def drop_corrupt(df: DataFrame, **kwargs) -> DataFrame:
    return df.where(keep_unless(corrupt(**kwargs)))


def drop_outliers(df: DataFrame, **kwargs) -> DataFrame:
    return df.where(keep_unless(outlier(**kwargs)))


def parse_date(df: DataFrame, column: str = "fl_date", strict: bool = True) -> DataFrame:
    """Text to timestamp. ``strict`` stops on a bad date, otherwise it becomes NULL."""
    convert = F.to_timestamp if strict else F.try_to_timestamp
    return df.withColumn(column, convert(F.col(column).cast("string")))


def keep_columns(df: DataFrame, wanted: Sequence[str] = tuple(FLIGHT_COLUMNS)) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def impute_causes(df: DataFrame, columns: Sequence[str] = tuple(CAUSE_COLUMNS.values())) -> DataFrame:
    """Cause minutes as numbers; missing or unreadable minutes mean 0."""
    return df.withColumns({c: number_or_zero(F.col(c)) for c in columns if c in df.columns})


def clean_flights(
    df: DataFrame,
    low: float = DELAY_FLOOR,
    high: float = DELAY_CEILING,
    strict_dates: bool = True,
) -> DataFrame:
    """Raw flights to the flight table: one scan, no shuffle."""
    steps = drop_corrupt(df).drop("year")
    if dict(steps.dtypes).get("fl_date") == "string":
        steps = parse_date(steps, strict=strict_dates)
    return drop_outliers(impute_causes(keep_columns(steps)), low=low, high=high)


AUDIT_SCHEMA = "step int, name string, row_count bigint, column_count int"


def audit_measures(low: float = DELAY_FLOOR, high: float = DELAY_CEILING) -> list[Column]:
    """Rows before cleaning and after each filter, as aggregates over the raw flights."""
    kept = keep_unless(corrupt())
    inside = kept & keep_unless(outlier(low, high))
    return [
        F.count(F.lit(1)).alias("initial"),
        F.count_if(kept).alias("whole"),
        F.count_if(inside).alias("inside"),
    ]


def audit_steps(df: DataFrame) -> list[tuple[int, str, str, int]]:
    """Step, name, the measure that counts its rows, and its number of columns."""
    wide, narrow = len(df.columns), len(keep_columns(df).columns)
    return [
        (1, "initial", "initial", wide),
        (2, "drop_corrupt", "whole", wide),
        (3, "drop_year", "whole", len(df.drop("year").columns)),
        (4, "keep_columns", "whole", narrow),
        (5, "drop_outliers", "inside", narrow),
    ]


def clean_audit(
    df: DataFrame, low: float = DELAY_FLOOR, high: float = DELAY_CEILING
) -> DataFrame:
    """Rows and columns left after each cleaning step, counted in one scan."""
    rows = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.lit(name).alias("name"),
                F.col(measure).alias("row_count"),
                F.lit(width).alias("column_count"),
            )
            for step, name, measure, width in audit_steps(df)
        ]
    )
    return df.agg(*audit_measures(low, high)).select(F.inline(rows))


def write_clean(
    df: DataFrame,
    path: str,
    low: float = DELAY_FLOOR,
    high: float = DELAY_CEILING,
    refused: int | None = None,
    columns: int | None = None,
) -> DataFrame:
    """Write the clean flights as Parquet and return the audit, counted while writing.

    With the number of rows a reader has ``refused``, and of the ``columns`` it found, the
    audit begins with everything that was read.
    """
    seen = Observation()
    observed = df.observe(seen, *audit_measures(low, high))
    clean_flights(observed, low, high).write.mode("overwrite").parquet(path)
    counts = seen.get
    rows = [(step, name, counts[m], width) for step, name, m, width in audit_steps(df)]
    if refused is not None:
        rows.insert(0, (0, "read", counts["initial"] + refused, columns or len(df.columns)))
    return df.sparkSession.createDataFrame(rows, AUDIT_SCHEMA)

"""Column profiles. Each is one aggregation over the columns it needs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import nan_to_null, percent
from tarmac.operators.clean import outlier
from tarmac.schema import DELAY_CEILING, DELAY_COLUMNS, DELAY_FLOOR


def _missing(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    if dict(df.dtypes)[column] in ("double", "float"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, one row per column."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in columns]
    )
    return counts.select(F.inline(rows))


def value_limits(df: DataFrame, columns: Sequence[str] = DELAY_COLUMNS) -> DataFrame:
    """Smallest and largest value per column, one row per column."""
    measures = []
    for c in columns:
        value = nan_to_null(F.col(f"`{c}`").cast("double"))
        measures += [F.min(value).alias(f"{c}_min"), F.max(value).alias(f"{c}_max")]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"`{c}_min`").alias("smallest"),
                F.col(f"`{c}_max`").alias("largest"),
            )
            for c in columns
        ]
    )
    return df.agg(*measures).select(F.inline(rows))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with how often they occur, NULL first."""
    return (
        df.groupBy(F.col(f"`{column}`").alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.asc_nulls_first("value"))
    )


def outlier_rate(
    df: DataFrame, low: float = DELAY_FLOOR, high: float = DELAY_CEILING
) -> DataFrame:
    """Rows outside the delay band and their share in percent."""
    bad = F.count_if(outlier(low, high))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        bad.alias("outliers"),
        percent(bad, F.count(F.lit(1))).alias("outlier_percent"),
    )


def uncoded_cancellations(df: DataFrame) -> DataFrame:
    """Null profile of the cancelled flights that carry no cancellation code."""
    uncoded = F.col("cancellation_code").isNull() & (F.col("cancelled") == 1)
    return null_counts(df.where(uncoded))


def quality_counts(df: DataFrame) -> DataFrame:
    """Rows that contradict the flag conventions, counted in one scan."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if((F.col("cancelled") == 0) & F.col("cancellation_code").isNotNull()).alias(
            "code_on_flown"
        ),
        F.count_if((F.col("cancelled") == 1) & F.col("cancellation_code").isNull()).alias(
            "cancelled_without_code"
        ),
        F.count_if(F.coalesce(~F.col("cancelled").isin(0, 1), F.lit(True))).alias(
            "unknown_flag"
        ),
    )


def preparation_profile(
    df: DataFrame, low: float = DELAY_FLOOR, high: float = DELAY_CEILING
) -> DataFrame:
    """What preparation reports of the raw flights: ``measure, column_name, value``.

    Missing values per column, limits of the delays, outliers and their percentage, missing
    values of the cancelled flights without a code, and how often each flag occurs. One scan:
    everything is counted per flag, and the few rows of that are summed.
    """
    uncoded = F.col("cancellation_code").isNull() & (F.col("cancelled") == 1)
    measures: list[tuple[str, str, Column, Callable[[Column], Column]]] = []
    for c in df.columns:
        measures.append(("nulls", c, F.count_if(_missing(df, c)), F.sum))
        measures.append(("nulls_uncoded", c, F.count_if(uncoded & _missing(df, c)), F.sum))
    for c in DELAY_COLUMNS:
        value = nan_to_null(F.col(f"`{c}`").cast("double"))
        measures += [("smallest", c, F.min(value), F.min), ("largest", c, F.max(value), F.max)]
    measures += [
        ("rows", "", F.count(F.lit(1)), F.sum),
        ("outliers", "", F.count_if(outlier(low, high)), F.sum),
    ]
    per_flag = df.groupBy(F.col("cancelled").alias("_flag")).agg(
        *[m.alias(f"_{i}") for i, (_, _, m, _) in enumerate(measures)]
    )
    rows_at, bad_at = (F.col(f"_{len(measures) - back}") for back in (2, 1))
    flag = F.coalesce(F.col("_flag").cast("string"), F.lit("missing"))
    flags = F.collect_list(F.struct(flag.alias("name"), rows_at.alias("n")))
    merged = per_flag.agg(
        *[merge(F.col(f"_{i}")).alias(f"_{i}") for i, (*_, merge) in enumerate(measures)],
        flags.alias("_flags"),
    )

    def entry(name: Column, column: Column, value: Column) -> Column:
        return F.struct(
            name.alias("measure"), column.alias("column_name"), value.cast("double").alias("value")
        )

    # Without rows every count is 0.
    values = [
        F.coalesce(F.col(f"_{i}"), F.lit(0)) if merge is F.sum else F.col(f"_{i}")
        for i, (*_, merge) in enumerate(measures)
    ]
    rows = [entry(F.lit(n), F.lit(c), v) for (n, c, *_), v in zip(measures, values)]
    rows.append(entry(F.lit("outlier_percent"), F.lit(""), percent(bad_at, rows_at)))
    each = F.transform("_flags", lambda f: entry(F.lit("flags"), f["name"], f["n"]))
    return merged.select(F.inline(F.concat(F.array(*rows), each)))

"""Row ranks and first-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_column: str = "ranking",
) -> DataFrame:
    """First ``k`` rows of each group.

    Spark trims every task to ``k`` rows per group before the shuffle, so a group that
    holds most of the input still sends only ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank_column, F.row_number().over(window))
    return ranked.where(F.col(rank_column) <= k)


def top_n(df: DataFrame, order: Sequence[str | Column], n: int = 10) -> DataFrame:
    """First ``n`` rows of the whole; each task keeps ``n`` rows, nothing is fully sorted."""
    return df.orderBy(*order).limit(n)

"""Missing values: NaN and NULL mean the same thing, and unknown never drops a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it must not reach a comparison."""
    return F.nanvl(value, F.lit(None).cast("double"))


def keep_unless(bad: Column) -> Column:
    """True where ``bad`` is false *or unknown*; a plain NOT would lose the unknown rows."""
    return ~F.coalesce(bad, F.lit(False))


def text_to_number(text: Column) -> Column:
    """Number written in ``text``, or NULL."""
    return nan_to_null(text.try_cast("double"))


def number_or_zero(value: Column) -> Column:
    """Lenient number: text that is no number, NaN and NULL all become 0."""
    return F.coalesce(text_to_number(value), F.lit(0.0))

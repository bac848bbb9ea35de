"""Rounding and ratios.

Rounding is half-up on decimals. Sums are exact, and so are their quotients, which keep at
least sixteen places, so neither the order of the rows nor the size of a group moves a mean
onto or off a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Minutes with up to six places; sums of it hold 22 digits before the point.
EXACT, EXACT_SUM = T.DecimalType(18, 6), T.DecimalType(28, 6)
# A number of millionths is added in two parts, of which the lower one has so many bits.
LOW_BITS = 20
WIDE = T.DecimalType(38, 16)


def rounded(value: Column, digits: int = 2) -> Column:
    return F.round(value.cast(WIDE), digits).cast(T.DecimalType(10, digits))


def exact_sum(value: Column) -> Column:
    """Sum that does not depend on the order rows arrive in.

    Each value is a whole number of millionths, and its upper and lower bits are added
    apart, so rows add whole numbers and only the sums become decimals. The lower part holds 2^43
    rows, the upper one as many of a million minutes each; beyond that Spark stops.
    """
    millionths = F.rint(value.cast("double") * 1e6).cast("bigint")
    high = F.sum(F.shiftright(millionths, LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(millionths.bitwiseAND((1 << LOW_BITS) - 1)).cast("decimal(20,0)")
    whole = high * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low
    return (whole * F.lit("0.000001").cast("decimal(6,6)")).cast(EXACT_SUM)


def mean_of(total: Column, count: Column, empty: float | None = None) -> Column:
    """Mean from exact partial sums; ``empty`` is the value of a group without rows."""
    mean = F.try_divide(total, count.cast("decimal(20,0)"))
    return mean if empty is None else F.coalesce(mean, F.lit(empty).cast(EXACT))


def exact_percent(part: Column, whole: Column) -> Column:
    """Percentage of two counts as a decimal."""
    return F.try_divide((part * 100).cast("decimal(22,6)"), whole.cast("decimal(20,0)"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


def ratio(a: Column, b: Column, digits: int = 2) -> Column:
    """Rounded a / b; NULL when b is zero or either side is missing."""
    return rounded(F.try_divide(a.cast("double"), b.cast("double")), digits)


def exact_mean(value: Column) -> Column:
    """Mean whose sum is exact, so it does not depend on the order rows arrive in."""
    return mean_of(exact_sum(value), F.count(value)).cast("double")


def as_doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles: ``-4.80`` prints as ``-4.8``."""
    decimals = {
        f.name: F.col(f"`{f.name}`").cast("double")
        for f in df.schema.fields
        if isinstance(f.dataType, T.DecimalType)
    }
    return df.withColumns(decimals)

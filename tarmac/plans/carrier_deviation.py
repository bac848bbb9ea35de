"""Carriers ranked within each airport, and how far they are from the airport's mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import exact_percent, exact_sum, mean_of, nan_to_null, rounded
from tarmac.plans.grouped import Grouped
from tarmac.schema import CARRIER_DEVIATION_HEADER, MEAN


def _flown(delay: str, cancelled: str) -> Column:
    return F.when(F.col(cancelled) == 0, nan_to_null(F.col(delay)))


def airport_means(
    flights: DataFrame, origin: str = "origin", cancelled: str = "cancelled"
) -> DataFrame:
    """Mean departure delay of every airport's flown flights."""
    dep = _flown("dep_delay", cancelled)
    return flights.groupBy(F.col(origin).alias("aeroporto_partenza")).agg(
        rounded(mean_of(exact_sum(dep), F.count(dep))).alias("ritardo_medio_complessivo")
    )


def carrier_gaps(
    origin: str = "origin",
    carrier: str = "op_unique_carrier",
    cancelled: str = "cancelled",
    precision: str = "rounded",
    empty_mean: float | None = None,
    nulls: str = "first",
    keep_empty_airports: bool = True,
) -> Grouped:
    """Report 3.3: rank 1 is the lowest mean departure delay, carrier name breaks ties.

    ``precision`` says which means ``differenza`` subtracts: both ``rounded``, both
    ``exact``, or ``mixed`` (rounded carrier, exact airport). ``nulls`` places carriers
    without any flown departure ``first`` or ``last``. Without ``keep_empty_airports``
    airports that have no flown departure at all are left out.

    The flights are aggregated once, to one row per airport and carrier; airport means
    come from those partial sums. Both windows share one shuffle of these few rows: an
    airport contributes as many as it has carriers, however many flights it has.
    """
    if precision not in ("rounded", "exact", "mixed"):
        raise ValueError("precision is 'rounded', 'exact' or 'mixed'")
    dep, arr = _flown("dep_delay", cancelled), _flown("arr_delay", cancelled)
    carrier_mean = mean_of(F.col("dep_sum"), F.col("dep_n"), empty_mean)
    arrival_mean = mean_of(F.col("arr_sum"), F.col("arr_n"), empty_mean)
    airport_mean = mean_of(F.col("airport_sum"), F.col("airport_n"))
    shown = F.col("ritardo_medio_partenza")
    gap = {
        "rounded": lambda: shown - rounded(airport_mean),
        "exact": lambda: carrier_mean - airport_mean,
        "mixed": lambda: shown - airport_mean,
    }[precision]()
    rate = exact_percent(F.col("cancellati"), F.col("numero_voli"))
    columns = {
        "ritardo_medio_arrivo": rounded(arrival_mean),
        "tasso_cancellazione": rounded(rate, 1),
        "differenza": rounded(gap) if precision != "rounded" else gap.cast(MEAN),
    }

    def finish(groups: DataFrame, by: list[str]) -> DataFrame:
        airport = Window.partitionBy(*by, "aeroporto_partenza")
        place = F.asc_nulls_first if nulls == "first" else F.asc_nulls_last
        rank = F.row_number().over(airport.orderBy(place("ritardo_medio_partenza"), "compagnia"))
        stats = (
            groups.withColumn("ritardo_medio_partenza", rounded(carrier_mean))
            # Ranked first: the sums then find the airports already sorted together.
            .withColumn("classifica", rank)
            .withColumns(
                {
                    "airport_sum": F.sum("dep_sum").over(airport),
                    "airport_n": F.sum("dep_n").over(airport),
                }
            )
        )
        if not keep_empty_airports:
            stats = stats.where(F.col("airport_n") > 0)
        kept = [
            columns[c].alias(c) if c in columns else F.col(c) for c in CARRIER_DEVIATION_HEADER
        ]
        return stats.select(*by, *kept)

    return Grouped(
        keys={"aeroporto_partenza": F.col(origin), "compagnia": F.col(carrier)},
        sums={
            "numero_voli": F.count(F.lit(1)),
            "cancellati": F.count_if(F.col(cancelled) == 1),
            "dep_sum": exact_sum(dep),
            "dep_n": F.count(dep),
            "arr_sum": exact_sum(arr),
            "arr_n": F.count(arr),
        },
        finish=finish,
    )


def carrier_deviation(flights: DataFrame, **options) -> DataFrame:
    """Report 3.3 of ``flights``, see ``carrier_gaps``."""
    return carrier_gaps(**options).of(flights)

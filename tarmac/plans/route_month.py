"""Delay and cancellation statistics per carrier, departure airport and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import exact_percent, exact_sum, mean_of, nan_to_null, rounded
from tarmac.plans.grouped import Grouped
from tarmac.schema import ROUTE_MONTH_HEADER


def route_month(
    carrier: str = "op_unique_carrier",
    origin: str = "origin",
    month: str = "month",
    delay: str = "arr_delay",
    cancelled: str = "cancelled",
    empty_mean: float | None = None,
) -> Grouped:
    """Report 3.1. Extremes of a group without flown arrivals are 0.0, its mean NULL.

    ``empty_mean`` replaces that NULL. The only shuffle of facts carries one partly
    aggregated row per group and task.
    """
    flown = F.when(F.col(cancelled) == 0, nan_to_null(F.col(delay)))

    def finish(groups: DataFrame, by: list[str]) -> DataFrame:
        rate = exact_percent(F.col("cancellati"), F.col("numero_voli"))
        columns = {
            "ritardo_minimo": F.coalesce("least", F.lit(0.0)),
            "ritardo_massimo": F.coalesce("most", F.lit(0.0)),
            "ritardo_medio": rounded(mean_of(F.col("total"), F.col("flown"), empty_mean)),
            "tasso_cancellazione": rounded(rate, 1),
        }
        kept = [columns[c].alias(c) if c in columns else F.col(c) for c in ROUTE_MONTH_HEADER]
        return groups.select(*by, *kept)

    return Grouped(
        keys={
            "codice": F.col(carrier),
            "aeroporto_partenza": F.col(origin),
            "mese": F.col(month),
        },
        sums={
            "numero_voli": F.count(F.lit(1)),
            "total": exact_sum(flown),
            "flown": F.count(flown),
            "cancellati": F.count_if(F.col(cancelled) == 1),
        },
        least={"least": F.min(flown)},
        most={"most": F.max(flown)},
        finish=finish,
    )


def route_month_stats(flights: DataFrame, **options) -> DataFrame:
    """Report 3.1 of ``flights``, see ``route_month``."""
    return route_month(**options).of(flights)

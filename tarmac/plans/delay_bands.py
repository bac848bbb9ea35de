"""Departure delay bands and the most frequent causes per airport and month.

Everything is counted in one aggregation of the flights: bands, means and one counter per
cause. Ranking the causes then happens inside each aggregated row, so there is neither a
join nor a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import (
    cause_label,
    exact_sum,
    mean_of,
    named_counts,
    nan_to_null,
    ranked_counts,
    rounded,
)
from tarmac.plans.grouped import Grouped
from tarmac.schema import (
    BAND_EDGES,
    CANCELLATION_CODES,
    CAUSE_COLUMNS,
    DELAY_BAND_HEADER,
)

# Report column names of the low, middle and high band.
BAND_COLUMNS = {
    "low": ("numero_ritardi_basso", "dep_avg_basso", "arr_avg_basso"),
    "mid": ("numero_ritardi_medio", "dep_avg_medio", "arr_avg_medio"),
    "high": ("numero_ritardo_alto", "dep_avg_alto", "arr_avg_alto"),
}
# End of fixed values.


def _bands(edges: tuple[float, float]) -> dict[str, Column]:
    """Both edges belong to the middle band; an unknown delay belongs to none."""
    low, high = edges
    dep = nan_to_null(F.col("dep_delay"))
    flown = F.col("cancelled") == 0
    return {
        "low": flown & (dep < low),
        "mid": flown & dep.between(low, high),
        "high": flown & (dep > high),
    }


def _band_sums(edges: tuple[float, float]) -> dict[str, Column]:
    """Per band the flights, and sums and counts of both delays."""
    dep, arr = nan_to_null(F.col("dep_delay")), nan_to_null(F.col("arr_delay"))
    sums = {}
    for band, inside in _bands(edges).items():
        in_dep, in_arr = F.when(inside, dep), F.when(inside, arr)
        sums |= {
            BAND_COLUMNS[band][0]: F.count(in_dep),
            f"{band}_dep": exact_sum(in_dep),
            f"{band}_arr": exact_sum(in_arr),
            f"{band}_arr_n": F.count(in_arr),
        }
    return sums


def _band_columns(empty_mean: float | None) -> list[Column]:
    columns = []
    for band, (number, dep_name, arr_name) in BAND_COLUMNS.items():
        dep = mean_of(F.col(f"{band}_dep"), F.col(number), empty_mean)
        arr = mean_of(F.col(f"{band}_arr"), F.col(f"{band}_arr_n"), empty_mean)
        columns += [F.col(number), rounded(dep).alias(dep_name), rounded(arr).alias(arr_name)]
    return columns


def _cause_measures(codes_on: str) -> dict[str, Column]:
    """Flights per cause: delay causes of flown flights plus cancellation codes."""
    if codes_on not in ("any", "cancelled"):
        raise ValueError("codes_on is 'any' or 'cancelled'")
    flown = F.col("cancelled") == 0
    coded = {name: F.col("cancellation_code") == code for code, name in CANCELLATION_CODES.items()}
    if codes_on == "cancelled":
        coded = {name: c & F.coalesce(~flown, F.lit(True)) for name, c in coded.items()}
    measures = {}
    for name, minutes in CAUSE_COLUMNS.items():
        hits = F.when(flown & (nan_to_null(F.col(minutes).cast("double")) > 0), 1).otherwise(0)
        if name in coded:
            hits = hits + F.when(coded[name], 1).otherwise(0)
        measures[name] = F.sum(hits)
    return measures


def _keys(origin: str, month: str) -> dict[str, Column]:
    return {"aeroporto_partenza": F.col(origin), "mese": F.col(month)}


def band_stats(
    flights: DataFrame,
    origin: str = "origin",
    month: str = "month",
    edges: tuple[float, float] = BAND_EDGES,
    empty_mean: float | None = None,
) -> DataFrame:
    """Flights and mean delays per band."""
    keys = _keys(origin, month)

    def finish(groups: DataFrame, by: list[str]) -> DataFrame:
        return groups.select(*by, *keys, *_band_columns(empty_mean))

    return Grouped(keys, _band_sums(edges), finish).of(flights)


def _cause_entries(flights: DataFrame, origin: str, month: str, codes_on: str) -> DataFrame:
    causes = _cause_measures(codes_on)
    entries = named_counts({c: F.col(f"`{c}`") for c in causes}).alias("entries")
    keys = _keys(origin, month)
    return Grouped(keys, causes, lambda groups, by: groups.select(*by, *keys, entries)).of(flights)


def cause_counts(
    flights: DataFrame, origin: str = "origin", month: str = "month", codes_on: str = "any"
) -> DataFrame:
    """Flights per airport, month and cause, one row per cause that occurs."""
    counted = _cause_entries(flights, origin, month, codes_on)
    return counted.select("aeroporto_partenza", "mese", F.inline("entries")).drop("order")


def cause_top_k(
    flights: DataFrame,
    k: int = 3,
    origin: str = "origin",
    month: str = "month",
    codes_on: str = "any",
) -> DataFrame:
    """The ``k`` most frequent causes per airport and month with their rank."""
    counted = _cause_entries(flights, origin, month, codes_on)
    ranked = counted.select(
        "aeroporto_partenza",
        "mese",
        F.posexplode(ranked_counts(F.col("entries"), k)).alias("position", "entry"),
    )
    return ranked.select(
        "aeroporto_partenza",
        "mese",
        F.col("entry.causa").alias("causa"),
        F.col("entry.frequenza").alias("frequenza"),
        (F.col("position") + 1).alias("ranking"),
    )


def delay_band(
    origin: str = "origin",
    month: str = "month",
    edges: tuple[float, float] = BAND_EDGES,
    k: int = 3,
    empty_mean: float | None = None,
    codes_on: str = "any",
) -> Grouped:
    """Report 3.2. ``codes_on='cancelled'`` ignores cancellation codes of flown flights."""
    causes = _cause_measures(codes_on)
    keys = _keys(origin, month)

    def finish(groups: DataFrame, by: list[str]) -> DataFrame:
        label = cause_label(named_counts({c: F.col(f"`{c}`") for c in causes}), k)
        columns = [*keys, *_band_columns(empty_mean), label.alias("cause_maggiori")]
        return groups.select(*by, *columns).select(*by, *DELAY_BAND_HEADER)

    return Grouped(keys, _band_sums(edges) | causes, finish)


def delay_band_report(flights: DataFrame, **options) -> DataFrame:
    """Report 3.2 of ``flights``, see ``delay_band``."""
    return delay_band(**options).of(flights)

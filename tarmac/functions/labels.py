"""Cause counters held as an array of (frequency, name) inside one aggregated row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_counts(counts: dict[str, Column]) -> Column:
    """Array of structs for the causes that occur at all."""
    entries = F.array(
        *[
            F.struct((-n).alias("order"), F.lit(name).alias("causa"), n.alias("frequenza"))
            for name, n in counts.items()
        ]
    )
    return F.filter(entries, lambda e: e["frequenza"] > 0)


def ranked_counts(entries: Column, k: int) -> Column:
    """The ``k`` most frequent entries, names ascending among equals."""
    return F.slice(F.sort_array(entries), 1, k)


def cause_label(entries: Column, k: int = 3) -> Column:
    """Text such as ``"['NAS (46 voli)', 'Carrier (32 voli)']"``, quotes included."""
    texts = F.transform(
        ranked_counts(entries, k),
        lambda e: F.concat(F.lit("'"), e["causa"], F.lit(" ("), e["frequenza"], F.lit(" voli)'")),
    )
    return F.concat(F.lit('"['), F.array_join(texts, ", "), F.lit(']"'))

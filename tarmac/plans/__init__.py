"""The three flight reports."""

from tarmac.plans.carrier_deviation import airport_means, carrier_deviation, carrier_gaps
from tarmac.plans.delay_bands import (
    band_stats,
    cause_counts,
    cause_top_k,
    delay_band,
    delay_band_report,
)
from tarmac.plans.route_month import route_month, route_month_stats

__all__ = [
    "airport_means",
    "band_stats",
    "carrier_deviation",
    "carrier_gaps",
    "cause_counts",
    "cause_top_k",
    "delay_band",
    "delay_band_report",
    "route_month",
    "route_month_stats",
]

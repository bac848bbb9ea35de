"""Column expressions used by the operators. All of them stay inside the JVM."""

from tarmac.functions.labels import cause_label, named_counts, ranked_counts
from tarmac.functions.missing import keep_unless, nan_to_null, number_or_zero, text_to_number
from tarmac.functions.numeric import (
    as_doubles,
    exact_mean,
    exact_percent,
    exact_sum,
    mean_of,
    percent,
    ratio,
    rounded,
)
from tarmac.functions.rowhash import row_hash

__all__ = [
    "as_doubles",
    "cause_label",
    "exact_mean",
    "exact_percent",
    "exact_sum",
    "keep_unless",
    "mean_of",
    "named_counts",
    "nan_to_null",
    "number_or_zero",
    "percent",
    "ranked_counts",
    "ratio",
    "rounded",
    "row_hash",
    "text_to_number",
]

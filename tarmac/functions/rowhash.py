"""Seeded row hash that any engine with md5 can reproduce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 32


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """md5 over ``seed|value|value|...`` as 32 hex digits, NULL spelled ``\\N``."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))

"""A report as one aggregation of the facts and a last step on its few rows.

The aggregates of such a report can be merged, so the reports of all scales come from one
reading of the facts: nested samples are bands of rows, every band is aggregated once, and
the report of a scale merges the bands it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.sample import banded, copies_in
from tarmac.schema import SAMPLE_SEED, SCALES


@dataclass(frozen=True)
class Grouped:
    """``sums`` and the least and largest values of groups, and ``finish``, which makes the
    report of them.

    ``finish`` gets the rows of all groups and the names of columns that tell several reports
    apart; it keeps these.
    """

    keys: dict[str, Column]
    sums: dict[str, Column]
    finish: Callable[[DataFrame, list[str]], DataFrame]
    least: dict[str, Column] = field(default_factory=dict)
    most: dict[str, Column] = field(default_factory=dict)

    def of(self, facts: DataFrame) -> DataFrame:
        return self.finish(self._aggregated(facts), [])

    def _aggregated(self, facts: DataFrame, *more: str) -> DataFrame:
        measures = self.sums | self.least | self.most
        return facts.groupBy(*[k.alias(name) for name, k in self.keys.items()], *more).agg(
            *[m.alias(name) for name, m in measures.items()]
        )

    def at_scales(
        self,
        facts: DataFrame,
        scales: Sequence[float] = SCALES,
        key: Sequence[str] | None = None,
        seed: int = SAMPLE_SEED,
    ) -> DataFrame:
        """The report of every scaled set in one frame, told apart by ``scale`` in percent.

        Besides the counting passes that find where samples end, the facts are read once,
        and no row of them is repeated. What is merged has a row per group, band and scale.
        """
        parts = self._aggregated(banded(facts, scales, key, seed, "_band"), "_band")
        held = parts.select("*", F.inline(copies_in(scales, F.col("_band"))))
        merged = []
        for name in self.sums:
            total = F.sum(F.col(name) * F.col("copies").cast("decimal(4,0)"))
            merged.append(total.cast(parts.schema[name].dataType).alias(name))
        merged += [F.min(name).alias(name) for name in self.least]
        merged += [F.max(name).alias(name) for name in self.most]
        return self.finish(held.groupBy("scale", *self.keys).agg(*merged), ["scale"])

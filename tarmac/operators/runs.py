"""Comparing measurements of two environments.

A run table has the columns ``analysis, tech, pct, env, seconds`` and may hold any number
of repetitions per run, in the order of a ``repeat`` column. The log is read once: a hash
aggregation that starts before the shuffle reduces it to one row per run and environment, and
these rows are stored. Environments, columns of wide tables and all values are read from them.

Every function takes a log or what ``reduce_runs`` made of it, so several tables can share one
reading. A wide table has a column per analysis or scale of the log; ``run_cells`` holds the
same cells as rows, for logs of any number of analyses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import exact_sum, mean_of, ratio
from tarmac.functions.numeric import EXACT_SUM
from tarmac.schema import CLUSTER_OVERHEAD_SECONDS
from tarmac.session import stored

# The usual names of the two environments, in the order they are compared.
ENVIRONMENTS = ("Locale", "Cluster")
# End of fixed values.

RUN = ["analysis", "tech", "pct"]


_MEASURES = ["_at", "_first", "_total", "_n"]


def reduce_runs(runs: DataFrame, repeat: str = "repeat") -> DataFrame:
    """One stored row per run and environment: the first seconds by ``repeat``, their sum and count.

    What was reduced before is returned as it is.
    """
    if set(_MEASURES) <= set(runs.columns):
        return runs
    seconds = F.col("seconds")
    order = F.when(seconds.isNotNull(), F.col(repeat))
    reduced = runs.groupBy(*RUN, "env").agg(
        F.min(order).alias("_at"),
        F.min_by(seconds, order).cast("double").alias("_first"),
        exact_sum(seconds).alias("_total"),
        F.count(seconds).alias("_n"),
    )
    return stored(reduced, "runs")


def axis(runs: DataFrame, column: str) -> list:
    """The distinct values of ``column`` in order: what a wide table gets columns for."""
    rows = runs.select(column).where(F.col(column).isNotNull()).distinct()
    return sorted(r[0] for r in rows.collect())


def environments_of(runs: DataFrame) -> tuple[str, str]:
    """The two environments of a log; usual names in the usual order, others by name."""
    usual = {name: i for i, name in enumerate(ENVIRONMENTS)}
    found = sorted(axis(runs, "env"), key=lambda e: (usual.get(e, len(usual)), e))
    if len(found) == 1:
        found += [e for e in ENVIRONMENTS if e not in found][:1]
    if len(found) != 2:
        raise ValueError(f"two environments are compared, the log has {found}")
    return found[0], found[1]


def _seconds(how: str, here: Column) -> Column:
    """Seconds of the reduced rows selected by ``here``: the first by ``repeat``, or their mean."""
    if how == "mean":
        total = F.sum(F.when(here, F.col("_total"))).cast(EXACT_SUM)
        return mean_of(total, F.sum(F.when(here, F.col("_n")))).cast("double")
    return F.min_by(F.col("_first"), F.when(here, F.col("_at")))


def side_values(
    runs: DataFrame,
    keys: Sequence[str] = RUN,
    how: str = "first",
    repeat: str = "repeat",
    environments: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per ``keys`` with the seconds of both environments, ``a`` and ``b``.

    ``how`` is ``first`` (the lowest ``repeat`` wins) or ``mean``. The environments are
    those of the log unless two are named.
    """
    known = reduce_runs(runs, repeat)
    sides = [
        _seconds(how, F.col("env") == env).alias(name)
        for env, name in zip(environments or environments_of(known), ("a", "b"))
    ]
    return known.where("env is not null").groupBy(*keys).agg(*sides)


def _label() -> Column:
    return F.concat_ws(" / ", "analysis", "tech").alias("label")


def run_pivot(
    runs: DataFrame,
    pct: int = 100,
    environments: tuple[str, str] | None = None,
    how: str = "first",
    repeat: str = "repeat",
) -> DataFrame:
    """Technologies by analysis at one scale: seconds per environment and the speedup.

    The analyses are those of the whole log. A technology known to one environment only keeps
    its row.
    """
    known = reduce_runs(runs, repeat)
    environments = environments or environments_of(known)
    analyses = axis(known, "analysis")
    sides = side_values(known.where(F.col("pct") == pct), how=how, environments=environments)
    suffixes = [e.lower() for e in environments]
    wide = sides.groupBy("tech").pivot("analysis", analyses or [""]).agg(
        F.first("a").alias("a"), F.first("b").alias("b")
    )
    columns = ["tech"]
    for analysis in analyses:
        a, b = F.col(f"`{analysis}_a`"), F.col(f"`{analysis}_b`")
        columns += [
            a.alias(f"A{analysis}_{suffixes[0]}"),
            b.alias(f"A{analysis}_{suffixes[1]}"),
            ratio(a, b).alias(f"A{analysis}_speedup"),
        ]
    return wide.select(*columns).orderBy("tech")


def run_speedup(runs: DataFrame, **kwargs) -> DataFrame:
    """Speedup a / b of every run that both environments have."""
    both = side_values(runs, **kwargs).where("a is not null and b is not null")
    return both.select(*RUN, _label(), "a", "b", ratio(F.col("a"), F.col("b")).alias("speedup"))


def run_cells(
    runs: DataFrame,
    overhead: float = CLUSTER_OVERHEAD_SECONDS,
    how: str = "first",
    repeat: str = "repeat",
    environments: tuple[str, str] | None = None,
) -> DataFrame:
    """The cells of all wide tables as rows: one per run, with seconds, speedup and break-even.

    ``saves`` is ``yes``, ``no``, or ``-`` where a run is missing on either side.
    """
    sides = side_values(runs, how=how, repeat=repeat, environments=environments)
    speedup = ratio(F.col("a"), F.col("b")).alias("speedup")
    return sides.select(*RUN, _label(), "a", "b", speedup, _saves(overhead).alias("saves"))


def _saves(overhead: float) -> Column:
    saved = F.col("a") - F.col("b") - F.lit(float(overhead))
    return F.when(saved > 0, "yes").when(saved <= 0, "no").otherwise("-")


def speedup_matrix(runs: DataFrame, repeat: str = "repeat", **kwargs) -> DataFrame:
    """Speedups by label (rows) and scale (columns ``p10``, ``p25``, ... of the log)."""
    known = reduce_runs(runs, repeat)
    return _matrix(run_speedup(known, **kwargs), "speedup", axis(known, "pct"))


def seconds_matrix(
    runs: DataFrame, environment: str, how: str = "first", repeat: str = "repeat"
) -> DataFrame:
    """Seconds of one environment by label and scale."""
    known = reduce_runs(runs, repeat)
    here = known.where(F.col("env") == environment)
    values = here.groupBy(*RUN).agg(_seconds(how, F.lit(True)).alias("seconds"))
    return _matrix(values.select("*", _label()), "seconds", axis(known, "pct"))


def _matrix(values: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    wide = values.groupBy("label").pivot("pct", percents or [0]).agg(F.first(column))
    return wide.select("label", *[F.col(f"`{p}`").alias(f"p{p}") for p in percents]).orderBy(
        "label"
    )


def mean_speedup(runs: DataFrame, **kwargs) -> DataFrame:
    """Ratio of the mean seconds per technology and scale, over all analyses."""
    means = side_values(runs, keys=["tech", "pct"], how="mean", **kwargs)
    return (
        means.where("a is not null and b > 0")
        .select("tech", "pct", ratio(F.col("a"), F.col("b")).alias("speedup"))
        .orderBy("tech", "pct")
    )


def break_even(
    runs: DataFrame,
    overhead: float = CLUSTER_OVERHEAD_SECONDS,
    repeat: str = "repeat",
    **kwargs,
) -> DataFrame:
    """Does the second environment save more than its start-up cost?

    One row per technology and analysis of the log, one column per scale: ``yes``, ``no``,
    or ``-`` where a run is missing on either side. The runs are reduced once; the grid is
    read from the flags of each technology.
    """
    known = reduce_runs(runs, repeat)
    analyses, percents = axis(known, "analysis"), axis(known, "pct")
    place = F.concat_ws("/", F.col("pct").cast("string"), "analysis")
    flags = (
        side_values(known, **kwargs)
        .groupBy("tech")
        .agg(
            F.map_from_entries(F.collect_list(F.struct(place, _saves(overhead)))).alias("flags")
        )
    )
    grid = flags.withColumn("analysis", F.explode(F.lit(analyses).cast("array<string>")))
    cells = [
        F.coalesce(
            F.col("flags")[F.concat_ws("/", F.lit(str(p)), "analysis")], F.lit("-")
        ).alias(f"p{p}")
        for p in percents
    ]
    return grid.select("tech", "analysis", *cells).orderBy("tech", "analysis")


def run_summary(runs: DataFrame, pct: int = 100, **kwargs) -> DataFrame:
    """Mean seconds per side and speedup of every run at one scale, best speedup first."""
    sides = side_values(
        runs.where(F.col("pct") == pct), keys=["analysis", "tech"], how="mean", **kwargs
    )
    return sides.select(
        "analysis", "tech", "a", "b", ratio(F.col("a"), F.col("b")).alias("speedup")
    ).orderBy(F.desc_nulls_last("speedup"), "analysis", "tech")


def run_extremes(runs: DataFrame, pct: int = 100, **kwargs) -> DataFrame:
    """Largest and smallest speedup with their runs, and the mean speedup."""
    known = run_summary(runs, pct, **kwargs).where("speedup is not null")
    label = F.concat_ws(" / ", "analysis", "tech")
    rising = F.struct("speedup", "analysis", "tech")
    falling = F.struct(-F.col("speedup"), F.col("analysis"), F.col("tech"))
    mean = F.try_divide(F.sum("speedup"), F.count("speedup"))
    return known.agg(
        F.max("speedup").alias("best_speedup"),
        F.min_by(label, falling).alias("best_run"),
        F.min("speedup").alias("worst_speedup"),
        F.min_by(label, rising).alias("worst_run"),
        F.round(mean, 2).cast(T.DecimalType(10, 2)).alias("mean_speedup"),
    )

"""Command line: ``python -m tarmac <command>`` or through spark-submit.

    prepare    raw text -> clean Parquet, rejected lines, audit of the steps, profile
    scales     clean Parquet -> datasets of several sizes
    report     clean flights -> report 3.1, 3.2 or 3.3, its first rows, a run-log entry
    reconcile  two stored versions of a report -> summary
    runs       two run logs -> speedups and break-even
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession

from tarmac import schema as S
from tarmac.operators import runs
from tarmac.operators.clean import write_clean
from tarmac.operators.profile import preparation_profile
from tarmac.plans import carrier_deviation, delay_band_report, route_month_stats
from tarmac.session import build_session, stored
from tarmac.sources import (
    Loaded,
    read_csv,
    read_parquet,
    read_runs,
    reconcile_files,
    snapshot,
    timed,
    write_report,
    write_scales,
)

REPORTS = {
    "3.1": (route_month_stats, S.ROUTE_MONTH_REPORT, S.ROUTE_MONTH_KEY, S.ROUTE_MONTH_KEY),
    "3.2": (delay_band_report, S.DELAY_BAND_REPORT, S.DELAY_BAND_KEY, S.DELAY_BAND_KEY),
    "3.3": (
        carrier_deviation,
        S.CARRIER_DEVIATION_REPORT,
        S.CARRIER_DEVIATION_KEY,
        ["aeroporto_partenza", "classifica"],
    ),
}


def _flights(spark: SparkSession, path: str, fmt: str) -> tuple[DataFrame, Observation]:
    """The good rows, and the count of the others once a job has read them."""
    seen = Observation()
    loaded = (read_csv if fmt == "csv" else read_parquet)(spark, path, seen=seen)
    return loaded.good, seen


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """The text is read and parsed once, into a table of good and rejected lines."""
    loaded = read_csv(spark, args.raw, strict_dates=args.strict_dates)
    loaded = Loaded.of_lines(stored(loaded.lines, "lines"), loaded.columns)
    loaded.rejected.write.mode("overwrite").parquet(f"{args.out}/rejected")
    refused = spark.read.parquet(f"{args.out}/rejected").count()
    audit = write_clean(
        loaded.good, f"{args.out}/flights", refused=refused, columns=len(loaded.columns)
    )
    audit.write.mode("overwrite").parquet(f"{args.out}/audit")
    preparation_profile(loaded.good).write.mode("overwrite").parquet(f"{args.out}/profile")
    audit.orderBy("step").show(truncate=False)
    spark.read.parquet(f"{args.out}/profile").orderBy("measure", "column_name").show(200, False)


def scales(spark: SparkSession, args: argparse.Namespace) -> None:
    flights, seen = _flights(spark, args.flights, args.input)
    write_scales(flights, args.out, args.scale or S.SCALES, args.key, args.seed)
    print(f"refused rows: {seen.get['refused']}")


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    make, schema, keys, order = REPORTS[args.name]
    order = keys if args.order == "key" else order
    flights, seen = _flights(spark, args.flights, args.input)

    def job() -> None:
        write_report(make(flights), f"{args.out}/full", order)

    if args.log:
        timed(spark, args.log, args.pct, args.name, args.tech, job)
    else:
        job()
    print(f"refused rows: {seen.get['refused']}")
    snapshot(spark, f"{args.out}/full", f"{args.out}/top", schema, order, args.top)


def reconcile(spark: SparkSession, args: argparse.Namespace) -> None:
    _, schema, keys, _ = REPORTS[args.name]
    reconcile_files(spark, [(args.name, args.a, args.b, schema, keys)]).show(truncate=False)


def compare_runs(spark: SparkSession, args: argparse.Namespace) -> None:
    a, b = runs.ENVIRONMENTS
    log = runs.reduce_runs(read_runs(spark, args.a, a).unionByName(read_runs(spark, args.b, b)))
    for table in (
        runs.run_pivot(log, args.pct),
        runs.run_summary(log, args.pct),
        runs.speedup_matrix(log),
        runs.mean_speedup(log),
        runs.break_even(log, args.overhead),
        runs.run_extremes(log, args.pct),
    ):
        table.show(200, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarmac", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(required=True)

    def command(name, run, *positional):
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p)
        sub.set_defaults(run=run)
        return sub

    p = command("prepare", prepare, "raw", "out")
    p.add_argument("--strict-dates", action="store_true")
    p = command("scales", scales, "flights", "out")
    p.add_argument("--input", choices=["csv", "parquet"], default="parquet")
    p.add_argument("--scale", type=float, action="append")
    p.add_argument("--key", action="append")
    p.add_argument("--seed", type=int, default=S.SAMPLE_SEED)
    p = commands.add_parser("report")
    p.add_argument("name", choices=list(REPORTS))
    p.add_argument("flights")
    p.add_argument("out")
    p.add_argument("--input", choices=["csv", "parquet"], default="parquet")
    p.add_argument("--order", choices=["key", "rank"], default="rank")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--log")
    p.add_argument("--pct", type=int, default=100)
    p.add_argument("--tech", default="Spark_SQL")
    p.set_defaults(run=report)
    p = commands.add_parser("reconcile")
    p.add_argument("name", choices=list(REPORTS))
    p.add_argument("a")
    p.add_argument("b")
    p.set_defaults(run=reconcile)
    p = command("runs", compare_runs, "a", "b")
    p.add_argument("--pct", type=int, default=100)
    p.add_argument("--overhead", type=float, default=S.CLUSTER_OVERHEAD_SECONDS)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or build_session("tarmac"), args)


if __name__ == "__main__":
    main()

"""Registered queries: every operator of the library over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.functions import as_doubles
from tarmac.operators import clean, profile, ranking, reconcile, runs, sample
from tarmac.plans import (
    airport_means,
    band_stats,
    carrier_deviation,
    carrier_gaps,
    cause_counts,
    cause_top_k,
    delay_band,
    delay_band_report,
    route_month,
    route_month_stats,
)
from tarmac.plans.grouped import Grouped
from tarmac.session import scratch_path, stored
from tarmac.sources import (
    declare_flights,
    read_csv,
    read_ordered,
    read_parquet,
    read_report,
    read_runs,
    reconcile_files,
    snapshot,
    write_report,
    write_runs,
    write_scales,
)
from tarmac.sources.tables import flights_view, load, raw_view, runs_view

Query = Callable[[SparkSession, str], DataFrame]

# The test data's delays end at 120 minutes, so its cleaning band is narrower.
LOW, HIGH = -30.0, 110.0
# Columns in which many flights are equal.
FEW = ["origin", "month", "cancelled"]


def _on_flights(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: as_doubles(make(flights_view(spark, sf)))


def _on_raw(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: make(raw_view(spark, sf))


def _on_orders(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: make(load(spark, sf, "orders"))


def _on_runs(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: as_doubles(make(runs_view(spark, sf)))


def _at_scales(report: Callable[[], Grouped]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return as_doubles(report().at_scales(stored(flights_view(spark, sf), "flights")))

    return query


def _wall_clock(df: DataFrame) -> DataFrame:
    return df.withColumn("fl_date", F.col("fl_date").cast("timestamp_ntz"))


def _sample(fraction: float) -> Query:
    return _on_orders(lambda df: sample.exact_sample(df, fraction, key=["o_orderkey"]))


# --- sources and sinks ---------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    flights_view(spark, sf).write.option("header", True).csv(path)
    return _wall_clock(read_csv(spark, path).good)


def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    flights_view(spark, sf).write.parquet(path)
    return read_parquet(spark, path).good


def damaged_text(spark: SparkSession, sf: str, path: str) -> None:
    """The raw flights as text files of which some lines are damaged.

    Every file starts with a header, and some have more of them further down.
    """
    raw = raw_view(spark, sf)
    number = F.col("op_carrier_fl_num").cast("bigint")
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns}
    cells["dep_delay"] = F.when(number % 73 == 1, "late").otherwise(cells["dep_delay"])
    cells["cancelled"] = F.when(number % 79 == 2, "2").otherwise(cells["cancelled"])
    whole = F.concat_ws(",", *cells.values())
    short = F.concat_ws(",", *list(cells.values())[:-3])
    line = F.when(number % 71 == 3, short).otherwise(whole)
    header = ",".join(raw.columns)
    again = F.array(line, F.lit(header))
    lines = F.explode(F.when(number % 997 == 5, again).otherwise(F.array(line)))
    # One column without quotes: its name is the header line of every part file.
    options = {"header": True, "sep": "\x01", "quote": "", "escapeQuotes": False}
    raw.select(lines.alias(header)).write.options(**options).csv(path)


def csv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every accepted row by its cells, and every refused line with its reasons."""
    path = scratch_path(spark, "damaged")
    damaged_text(spark, sf, path)
    lines = read_csv(spark, path).lines
    cells = ["op_carrier_fl_num", "origin", "dep_delay", "arr_delay", "cancelled", "fl_date"]
    accepted = F.size("_reasons") == 0
    return lines.select(
        *[F.when(accepted, F.col(c)).alias(c) for c in cells[:-1]],
        F.when(accepted, F.col("fl_date")).cast("timestamp_ntz").alias("fl_date"),
        F.array_join("_reasons", "+").alias("reasons"),
        F.when(~accepted, F.col("_record")).alias("record"),
    )


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    runs_of = runs_view(spark, sf)
    sides = []
    for env in runs.ENVIRONMENTS:
        write_runs(runs_of.where(F.col("env") == env), f"{path}/{env}")
        sides.append(read_runs(spark, f"{path}/{env}", env))
    return sides[0].unionByName(sides[1])


def declared_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "table")
    flights_view(spark, sf).write.option("header", True).csv(path)
    table = "tarmac_declared_flights"
    declare_flights(spark, path, table, source="csv")
    return spark.sql(
        f"SELECT origin, cancelled, count(*) AS row_count, sum(dep_delay) AS dep_sum "
        f"FROM {table} GROUP BY origin, cancelled"
    )


def report_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    write_report(delay_band_report(flights_view(spark, sf)), path, S.DELAY_BAND_KEY)
    return as_doubles(read_report(spark, path, S.DELAY_BAND_REPORT))


def report_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    report = carrier_deviation(flights_view(spark, sf))
    order = ["aeroporto_partenza", "classifica"]
    write_report(report, f"{path}/full", order)
    snapshot(spark, f"{path}/full", f"{path}/top", S.CARRIER_DEVIATION_REPORT, order)
    return as_doubles(read_report(spark, f"{path}/top", S.CARRIER_DEVIATION_REPORT))


def scales_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "scales")
    orders = load(spark, sf, "orders")
    write_scales(orders, path, key=["o_orderkey"])
    layout = orders.schema.add("scale", "integer")
    return (
        spark.read.schema(layout)
        .parquet(f"{path}/parquet")
        .withColumn("format", F.lit("parquet"))
        .unionByName(
            spark.read.schema(layout)
            .option("header", True)
            .csv(f"{path}/csv")
            .withColumn("format", F.lit("csv"))
        )
    )


def reconcile_stored(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    flights = flights_view(spark, sf)
    write_report(carrier_deviation(flights), f"{path}/a", S.CARRIER_DEVIATION_KEY)
    write_report(
        carrier_deviation(flights, precision="exact"), f"{path}/b", S.CARRIER_DEVIATION_KEY
    )
    layout = (S.CARRIER_DEVIATION_REPORT, S.CARRIER_DEVIATION_KEY)
    return reconcile_files(
        spark,
        [
            ("3.3 stored", f"{path}/a", f"{path}/b", *layout),
            ("3.3 missing", f"{path}/a", f"{path}/none", *layout),
        ],
    )


def carrier_order(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report by airport and carrier, written and read back in its order."""
    path = scratch_path(spark, "order")
    write_report(carrier_deviation(flights_view(spark, sf)), path, S.CARRIER_DEVIATION_KEY)
    report = read_ordered(spark, path, S.CARRIER_DEVIATION_REPORT, S.CARRIER_DEVIATION_KEY)
    return as_doubles(report)


# --- comparisons of results ------------------------------------------------------------


def _full_and_half(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    flights = flights_view(spark, sf)
    half = sample.exact_sample(flights, 0.5)
    return as_doubles(route_month_stats(flights)), as_doubles(route_month_stats(half))


def _rounded_and_exact(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    flights = flights_view(spark, sf)
    return carrier_deviation(flights), carrier_deviation(flights, precision="exact")


def _plain_and_clean(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    flights = flights_view(spark, sf)
    inside = clean.drop_outliers(flights, low=LOW, high=HIGH)
    return as_doubles(route_month_stats(flights)), as_doubles(route_month_stats(inside))


def _keys_that_repeat(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Route statistics without the month in the key, each side lacking a part."""
    flights = flights_view(spark, sf)
    inside = clean.drop_outliers(flights, low=LOW, high=HIGH)
    kept = (F.col("codice") >= "C05") | (F.col("mese") == 1)
    a = as_doubles(route_month_stats(flights)).where(kept)
    b = as_doubles(route_month_stats(inside)).where(kept)
    return a.where("aeroporto_partenza <> 'FRANCE'"), b.where("codice <> 'C03'")


def reconcile_repeated(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys_that_repeat(spark, sf)
    return reconcile.reconcile(a, b, S.ROUTE_MONTH_KEY[:2], job="3.1 by route")


def differing_repeated(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys_that_repeat(spark, sf)
    return reconcile.differing_cells(a, b, S.ROUTE_MONTH_KEY[:2])


def differing_paired(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys_that_repeat(spark, sf)
    return reconcile.paired_cells(a, b, S.ROUTE_MONTH_KEY[:2])


def reconcile_reports(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _full_and_half(spark, sf)
    return reconcile.reconcile(a, b, S.ROUTE_MONTH_KEY, job="3.1")


def reconcile_precision(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _rounded_and_exact(spark, sf)
    return reconcile.reconcile(a, b, S.CARRIER_DEVIATION_KEY, job="3.3", tolerance=0.0)


def differing_cells(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _rounded_and_exact(spark, sf)
    return reconcile.differing_cells(a, b, S.CARRIER_DEVIATION_KEY, tolerance=0.0)


def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _full_and_half(spark, sf)
    return reconcile.side_by_side(a, b, S.ROUTE_MONTH_KEY)


def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.set_difference(*_plain_and_clean(spark, sf))


def multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["op_unique_carrier", "origin", "month", "dep_delay"]
    flights = flights_view(spark, sf).select(*columns)
    inside = clean.drop_outliers(flights, low=LOW, high=HIGH, delays=["dep_delay"])
    return reconcile.set_difference(flights, inside, multiplicity=True)


def _orders_changed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All orders, of which each side lacks some and the second has changed others."""
    orders, key = load(spark, sf, "orders"), F.col("o_orderkey")
    status = F.when(key % 997 == 7, "X").otherwise(F.col("o_orderstatus"))
    priority = F.when(key % 1499 != 11, F.col("o_orderpriority"))
    changed = orders.withColumns({"o_orderstatus": status, "o_orderpriority": priority})
    return orders.where(key % 1777 != 3), changed.where(key % 1999 != 5)


def differing_orders(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _orders_changed(spark, sf)
    return reconcile.paired_cells(a, b, ["o_orderkey"], checksums=True)


def set_difference_orders(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.set_difference(*_orders_changed(spark, sf), checksums=True)


QUERIES: dict[str, Query] = {
    # Views
    "flights_view": flights_view,
    "raw_view": raw_view,
    # Carrier, airport and month statistics
    "route_month_stats": _on_flights(route_month_stats),
    "route_month_top10": _on_flights(
        lambda df: ranking.top_n(route_month_stats(df), S.ROUTE_MONTH_KEY)
    ),
    "route_month_zero_mean": _on_flights(lambda df: route_month_stats(df, empty_mean=0.0)),
    # Delay bands and causes
    "band_stats": _on_flights(band_stats),
    "cause_counts": _on_flights(cause_counts),
    "cause_top3": _on_flights(cause_top_k),
    "cause_top3_window": _on_flights(
        lambda df: ranking.top_k_per_group(
            cause_counts(df), S.DELAY_BAND_KEY, [F.desc("frequenza"), F.asc("causa")], 3
        )
    ),
    "delay_band_report": _on_flights(delay_band_report),
    "delay_band_top10": _on_flights(
        lambda df: ranking.top_n(delay_band_report(df), S.DELAY_BAND_KEY)
    ),
    "delay_band_cancelled_codes": _on_flights(
        lambda df: delay_band_report(df, empty_mean=0.0, codes_on="cancelled")
    ),
    # Carrier ranking
    "airport_means": _on_flights(airport_means),
    "carrier_deviation": _on_flights(carrier_deviation),
    "carrier_deviation_top10": _on_flights(
        lambda df: ranking.top_n(carrier_deviation(df), ["aeroporto_partenza", "classifica"])
    ),
    "carrier_deviation_by_carrier": _on_flights(
        lambda df: ranking.top_n(carrier_deviation(df), S.CARRIER_DEVIATION_KEY)
    ),
    "carrier_order": carrier_order,
    "carrier_deviation_exact": _on_flights(lambda df: carrier_deviation(df, precision="exact")),
    "carrier_deviation_nulls_last": _on_flights(lambda df: carrier_deviation(df, nulls="last")),
    "carrier_deviation_zero_mean": _on_flights(
        lambda df: carrier_deviation(
            df, precision="mixed", empty_mean=0.0, keep_empty_airports=False
        )
    ),
    # Cleaning and profiling
    "drop_corrupt": _on_raw(clean.drop_corrupt),
    "impute_causes": _on_raw(clean.impute_causes),
    "drop_outliers": _on_flights(lambda df: clean.drop_outliers(df, low=LOW, high=HIGH)),
    "clean_flights": _on_raw(lambda df: _wall_clock(clean.clean_flights(df, low=LOW, high=HIGH))),
    "clean_audit": _on_raw(lambda df: clean.clean_audit(df, low=LOW, high=HIGH)),
    "null_counts": _on_raw(profile.null_counts),
    "delay_limits": _on_raw(profile.value_limits),
    "outlier_rate": _on_raw(lambda df: profile.outlier_rate(df, LOW, HIGH)),
    "distinct_cancelled": _on_raw(lambda df: profile.distinct_values(df, "cancelled")),
    "distinct_carriers": _on_raw(lambda df: profile.distinct_values(df, "op_unique_carrier")),
    "uncoded_cancellations": _on_raw(profile.uncoded_cancellations),
    "quality_counts": _on_raw(profile.quality_counts),
    "preparation_profile": _on_raw(lambda df: profile.preparation_profile(df, LOW, HIGH)),
    # Samples
    "sample_10": _sample(0.10),
    "sample_25": _sample(0.25),
    "sample_50": _sample(0.50),
    "sample_75": _sample(0.75),
    "sample_100": _sample(1.0),
    "oversample_150": _on_orders(lambda df: sample.oversample(df, 0.5, key=["o_orderkey"])),
    "sample_strata_25": _on_orders(
        lambda df: sample.exact_sample(
            df, 0.25, key=["o_orderkey"], strata=["o_orderpriority"]
        )
    ),
    "sample_flights_25": lambda spark, sf: sample.exact_sample(flights_view(spark, sf), 0.25),
    "sample_identical_25": _on_flights(lambda df: sample.exact_sample(df.select(*FEW), 0.25)),
    "sample_strata_identical_25": _on_flights(
        lambda df: sample.exact_sample(df.select(*FEW), 0.25, strata=["origin"])
    ),
    "sample_tied_25": _on_flights(
        lambda df: sample.exact_sample(
            df.select("op_carrier_fl_num", *FEW), 0.25, key=["op_carrier_fl_num"]
        )
    ),
    "shuffled_tied": _on_flights(
        lambda df: sample.numbered(
            sample.shuffled(df.select("op_carrier_fl_num", *FEW), key=["origin"])
        )
    ),
    "shuffled_identical": _on_flights(
        lambda df: sample.numbered(sample.shuffled(df.select(*FEW)))
    ),
    "shuffled_orders": _on_orders(
        lambda df: sample.numbered(sample.shuffled(df, key=["o_orderkey"]))
    ),
    "scaled_rows": _on_orders(lambda df: sample.scaled(df, (0.28, 0.29, 0.57, 1.5), key=["o_orderkey"])),
    "scaled_counts": _on_orders(
        lambda df: sample.scaled(df, key=["o_orderkey"])
        .groupBy("scale")
        .agg(F.count("*").alias("row_count"), F.sum("o_orderkey").alias("key_sum"))
    ),
    # The reports of all scales
    "route_month_scales": _at_scales(route_month),
    "delay_band_scales": _at_scales(delay_band),
    "carrier_deviation_scales": _at_scales(carrier_gaps),
    # Results compared
    "reconcile_reports": reconcile_reports,
    "reconcile_precision": reconcile_precision,
    "reconcile_stored": reconcile_stored,
    "differing_cells": differing_cells,
    "reconcile_repeated": reconcile_repeated,
    "differing_repeated": differing_repeated,
    "differing_paired": differing_paired,
    "differing_orders": differing_orders,
    "set_difference_orders": set_difference_orders,
    "side_by_side": side_by_side,
    "set_difference": set_difference,
    "multiset_difference": multiset_difference,
    # Runs compared
    "run_pivot": _on_runs(runs.run_pivot),
    "run_cells": _on_runs(lambda df: runs.run_cells(df, overhead=20.0)),
    "run_speedup": _on_runs(runs.run_speedup),
    "run_speedup_matrix": _on_runs(runs.speedup_matrix),
    "run_seconds_matrix": _on_runs(lambda df: runs.seconds_matrix(df, "Locale")),
    "run_mean_speedup": _on_runs(runs.mean_speedup),
    "run_break_even": _on_runs(lambda df: runs.break_even(df, overhead=20.0)),
    "run_summary": _on_runs(runs.run_summary),
    "run_extremes": _on_runs(runs.run_extremes),
    "run_log": run_log,
    # Stored and read back
    "csv_roundtrip": csv_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "csv_rejects": csv_rejects,
    "declared_table": declared_table,
    "report_roundtrip": report_roundtrip,
    "report_snapshot": report_snapshot,
    "scales_roundtrip": scales_roundtrip,
}

"""Plans have the shape they need at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tarmac.operators import ranking, reconcile
from tarmac.plans import carrier_deviation, cause_counts, delay_band_report, route_month_stats
from tarmac.schema import DELAY_BAND_KEY, FLIGHTS, ROUTE_MONTH_KEY


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    """Flights stored as Parquet, the way reports read them."""
    from tarmac.sources.tables import flights_view

    path = str(tmp_path_factory.mktemp("flights") / "p")
    flights = flights_view(spark, small)
    flights.withColumn("fl_date", F.col("fl_date").cast("timestamp")).write.parquet(path)
    return spark.read.schema(FLIGHTS).parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text, kind):
    return len(re.findall(rf"Exchange {kind}partitioning", text))


def test_reports_scan_once_and_aggregate_before_the_shuffle(stored):
    for report in (route_month_stats, delay_band_report, carrier_deviation):
        text = plan(report(stored))
        assert text.count("FileScan parquet") == 1
        assert "partial_count" in text and "SortAggregate" not in text
        assert "Join" not in text


def test_shuffles_per_report(stored):
    assert exchanges(plan(route_month_stats(stored)), "hash") == 1
    assert exchanges(plan(delay_band_report(stored)), "hash") == 1
    assert exchanges(plan(carrier_deviation(stored)), "hash") == 2
    assert "Window" not in plan(delay_band_report(stored))


def test_both_windows_share_one_sort(stored):
    text = plan(carrier_deviation(stored))
    assert len(re.findall(r"Sort \[.*\], false", text)) == 1


def test_top_rows_are_not_sorted_as_a_whole(stored):
    assert "TakeOrderedAndProject" in plan(ranking.top_n(route_month_stats(stored), ROUTE_MONTH_KEY))


def test_top_k_is_limited_before_the_shuffle(stored):
    ranked = ranking.top_k_per_group(cause_counts(stored), DELAY_BAND_KEY, ["causa"], 3)
    assert "WindowGroupLimit" in plan(ranked)


def test_comparison_pairs_rows_without_a_join(stored):
    for report, key in (
        (route_month_stats(stored), ROUTE_MONTH_KEY),
        (delay_band_report(stored), DELAY_BAND_KEY),
    ):
        text = plan(reconcile.reconcile(report, report, key))
        assert "Join" not in text and "SortAggregate" not in text


def test_comparisons_do_not_sort_their_inputs(spark, small):
    from tarmac.checks.registry import QUERIES

    for name in (
        "reconcile_reports",
        "reconcile_precision",
        "differing_cells",
        "side_by_side",
        "set_difference",
    ):
        assert exchanges(plan(QUERIES[name](spark, small)), "range") == 0


def test_run_logs_are_reduced_by_hash_aggregation(spark, small):
    from tarmac.operators import runs
    from tarmac.sources.tables import runs_view

    for how in ("first", "mean"):
        text = plan(runs.side_values(runs_view(spark, small), how=how))
        assert "SortAggregate" not in text and exchanges(text, "hash") == 1

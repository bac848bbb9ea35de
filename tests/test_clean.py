"""Cleaning keeps rows with unknown values and treats NaN as missing."""

import math

import pytest
from pyspark.errors import PySparkException

from tarmac.operators import clean, profile

NAN = math.nan


@pytest.fixture
def delays(spark):
    rows = [
        (1, 5.0, 6.0, 0, 0),
        (2, None, 6.0, 0, 0),
        (3, NAN, 6.0, 0, 0),
        (4, None, None, 1, 0),
        (5, 5.0, None, 0, 1),
        (6, -31.0, None, 0, 1),
        (7, -30.0, 1440.0, 0, 0),
        (8, 0.0, 1440.5, 0, 0),
        (9, NAN, NAN, 1, 0),
        (10, None, None, None, 0),
    ]
    return spark.createDataFrame(
        rows, "id int, dep_delay double, arr_delay double, cancelled int, diverted int"
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_drop_corrupt_keeps_unknown_flags(delays):
    assert ids(clean.drop_corrupt(delays)) == [1, 4, 5, 6, 7, 8, 9, 10]


def test_drop_outliers_keeps_missing_delays(delays):
    assert ids(clean.drop_outliers(delays)) == [1, 2, 3, 4, 5, 7, 9, 10]


def test_impute_causes(spark):
    df = spark.createDataFrame(
        [("12", None), ("12.0", 3.0), ("", NAN), ("abc", -1.0), (None, 0.0), (" 7 ", 1.0), ("a", 1.0)],
        "carrier_delay string, nas_delay double",
    )
    got = [tuple(r) for r in clean.impute_causes(df).collect()]
    assert got == [(12, 0), (12, 3), (0, 0), (0, -1), (0, 0), (7, 1), (0, 1)]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-28",)], "fl_date string")
    lenient = [r.fl_date for r in clean.parse_date(df, strict=False).collect()]
    assert lenient[0] is None and str(lenient[1]) == "2024-02-28 00:00:00"
    with pytest.raises(PySparkException):
        clean.parse_date(df).collect()


def test_keep_columns_skips_what_is_absent(spark):
    df = spark.createDataFrame([(1, 2, 3)], "year int, origin int, month int")
    assert clean.keep_columns(df).columns == ["month", "origin"]


def test_clean_flights_does_not_shuffle(spark, small):
    from tarmac.sources.tables import raw_view

    plan = clean.clean_flights(raw_view(spark, small))._jdf.queryExecution().executedPlan()
    assert "Exchange hashpartitioning" not in plan.toString()


def test_audit_counts_every_step(delays):
    audit = clean.clean_audit(delays).collect()
    assert [r.row_count for r in audit] == [10, 8, 8, 8, 6]
    assert [r.column_count for r in audit] == [5, 5, 5, 3, 3]


def test_profiles(delays, spark):
    nulls = {r.column_name: r.nulls for r in profile.null_counts(delays).collect()}
    assert nulls == {"id": 0, "dep_delay": 5, "arr_delay": 5, "cancelled": 1, "diverted": 0}
    limits = {r.column_name: (r.smallest, r.largest) for r in profile.value_limits(delays).collect()}
    assert limits == {"dep_delay": (-31.0, 5.0), "arr_delay": (6.0, 1440.5)}
    rate = profile.outlier_rate(delays).first()
    assert (rate.row_count, rate.outliers, rate.outlier_percent) == (10, 2, 20.0)
    values = [(r.value, r.row_count) for r in profile.distinct_values(delays, "cancelled").collect()]
    assert values == [(None, 1), (0, 7), (1, 2)]


def test_uncoded_and_contradicting_flags(make_flights):
    flights = make_flights(
        [
            {"cancelled": 1},
            {"cancelled": 1, "cancellation_code": "A"},
            {"cancellation_code": "B"},
            {"cancelled": 3},
            {"cancelled": None},
        ]
    )
    uncoded = {r.column_name: r.nulls for r in profile.uncoded_cancellations(flights).collect()}
    assert uncoded["cancellation_code"] == 1 and uncoded["origin"] == 0
    assert tuple(profile.quality_counts(flights).first()) == (5, 1, 1, 2)


def test_writing_counts_the_same_audit(spark, small, tmp_path):
    from tarmac.sources.tables import raw_view

    raw = raw_view(spark, small)
    audit = clean.write_clean(raw, str(tmp_path / "clean"), low=-30.0, high=110.0)
    assert audit.collect() == clean.clean_audit(raw, low=-30.0, high=110.0).collect()
    assert spark.read.parquet(str(tmp_path / "clean")).count() == audit.collect()[-1].row_count

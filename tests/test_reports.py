"""The reports on hand-written flights, and invariants on the test data."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.functions import mean_of, rounded
from tarmac.operators.sample import scaled
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
from tarmac.sources.tables import flights_view


def D(text):
    return None if text is None else Decimal(text)


@pytest.mark.parametrize(
    "value, expected",
    [(1.005, "1.01"), (180.625, "180.63"), (-0.125, "-0.13"), (-0.001, "0.00"), (2.5, "2.50")],
)
def test_rounding_is_half_up_without_negative_zero(spark, value, expected):
    got = spark.createDataFrame([(value,)], "x double").select(rounded(F.col("x"))).first()[0]
    assert str(got) == expected


def test_route_month_stats(make_flights):
    flights = make_flights(
        [
            {"arr_delay": -3.0},
            {"arr_delay": 10.0},
            {"arr_delay": None},
            {"arr_delay": 99.0, "cancelled": 1},
            {"month": 2, "cancelled": 1},
            {"month": 10, "arr_delay": math.nan},
        ]
    )
    rows = [tuple(r) for r in route_month_stats(flights).collect()]
    assert rows == [
        ("AA", "ABE", 4, -3.0, 10.0, D("3.50"), D("25.0"), 1),
        ("AA", "ABE", 1, 0.0, 0.0, None, D("100.0"), 2),
        ("AA", "ABE", 1, 0.0, 0.0, None, D("0.0"), 10),
    ]
    zero = route_month_stats(flights, empty_mean=0.0).collect()
    assert [r.ritardo_medio for r in zero] == [D("3.50"), D("0.00"), D("0.00")]


def test_unknown_flag_is_neither_flown_nor_cancelled(make_flights):
    row = route_month_stats(make_flights([{"arr_delay": 5.0, "cancelled": 2}])).first()
    assert (row.numero_voli, row.ritardo_medio, row.tasso_cancellazione) == (1, None, D("0.0"))


def test_band_edges_belong_to_the_middle(make_flights):
    delays = [14.99, 15.0, 60.0, 60.01, None, math.nan]
    flights = make_flights([{"dep_delay": d, "arr_delay": 1.0} for d in delays])
    row = band_stats(flights).first()
    assert (row.numero_ritardi_basso, row.numero_ritardi_medio, row.numero_ritardo_alto) == (
        1,
        2,
        1,
    )
    assert row.dep_avg_medio == D("37.50")


def test_band_means_have_their_own_denominators(make_flights):
    flights = make_flights(
        [{"dep_delay": 1.0, "arr_delay": 4.0}, {"dep_delay": 3.0, "arr_delay": None}]
    )
    row = band_stats(flights).first()
    assert (row.dep_avg_basso, row.arr_avg_basso, row.dep_avg_alto) == (D("2.00"), D("4.00"), None)
    assert band_stats(flights, empty_mean=0.0).first().dep_avg_alto == D("0.00")


def test_cause_label_orders_and_formats(make_flights):
    flights = make_flights(
        [
            {"late_aircraft_delay": 1.0, "carrier_delay": 2.0},
            {"late_aircraft_delay": 1.0, "carrier_delay": 2.0, "nas_delay": 5.0},
            {"cancelled": 1, "cancellation_code": "C"},
            {"cancelled": 1, "cancellation_code": "B"},
            {"cancelled": 1, "cancellation_code": "Z"},
            {"month": 2},
            {"month": 3, "weather_delay": None, "nas_delay": 1.0, "dep_delay": 1.0},
        ]
    )
    rows = {r.mese: r for r in delay_band_report(flights).collect()}
    # Three causes tie; the first three names win.
    assert (
        rows[1].cause_maggiori
        == "\"['Carrier (2 voli)', 'Late Aircraft (2 voli)', 'NAS (2 voli)']\""
    )
    assert rows[2].cause_maggiori == '"[]"'
    assert rows[3].cause_maggiori == "\"['NAS (1 voli)']\""
    assert rows[3].numero_ritardi_basso == 1
    assert delay_band_report(flights).columns == S.DELAY_BAND_HEADER


def test_code_on_a_flown_flight(make_flights):
    flights = make_flights([{"cancellation_code": "A"}, {"cancelled": 1, "cancellation_code": "A"}])
    assert [r.frequenza for r in cause_counts(flights).collect()] == [2]
    assert [r.frequenza for r in cause_counts(flights, codes_on="cancelled").collect()] == [1]


def test_cause_minutes_of_cancelled_flights_do_not_count(make_flights):
    assert cause_counts(make_flights([{"cancelled": 1, "nas_delay": 9.0}])).count() == 0


def test_cause_top_k_of_a_null_group(make_flights):
    flights = make_flights([{"origin": None, "nas_delay": 1.0}])
    assert [tuple(r) for r in cause_top_k(flights).collect()] == [(None, 1, "NAS", 1, 1)]


@pytest.fixture
def airport(make_flights):
    return make_flights(
        [
            {"op_unique_carrier": "AA", "dep_delay": 10.0, "arr_delay": 5.0},
            {"op_unique_carrier": "BB", "dep_delay": 2.0},
            {"op_unique_carrier": "BB", "dep_delay": 3.0},
            {"op_unique_carrier": "BB", "dep_delay": 3.0},
            {"op_unique_carrier": "CC", "cancelled": 1},
            {"op_unique_carrier": "DD", "dep_delay": 10.0},
            {"op_unique_carrier": "EE", "origin": "XYZ", "cancelled": 1},
        ]
    )


def test_carrier_deviation(airport):
    key = ["aeroporto_partenza", "classifica"]
    rows = [tuple(r) for r in carrier_deviation(airport).orderBy(*key).collect()]
    # Airport mean 28 / 5 = 5.6; a carrier without departures ranks first.
    assert rows == [
        ("ABE", "CC", 1, None, None, D("100.0"), None, 1),
        ("ABE", "BB", 3, D("2.67"), None, D("0.0"), D("-2.93"), 2),
        ("ABE", "AA", 1, D("10.00"), D("5.00"), D("0.0"), D("4.40"), 3),
        ("ABE", "DD", 1, D("10.00"), None, D("0.0"), D("4.40"), 4),
        ("XYZ", "EE", 1, None, None, D("100.0"), None, 1),
    ]


def test_carrier_deviation_options(airport):
    def order(**options):
        rows = carrier_deviation(airport, **options).orderBy("classifica").collect()
        return [(r.compagnia, r.classifica) for r in rows if r.aeroporto_partenza == "ABE"]

    assert order(nulls="last") == [("BB", 1), ("AA", 2), ("DD", 3), ("CC", 4)]
    kept = carrier_deviation(airport, keep_empty_airports=False)
    assert kept.where("aeroporto_partenza = 'XYZ'").count() == 0
    zero = carrier_deviation(airport, empty_mean=0.0, precision="mixed")
    zero = zero.orderBy("aeroporto_partenza", "classifica").first()
    assert (zero.compagnia, zero.ritardo_medio_partenza, zero.differenza) == (
        "CC",
        D("0.00"),
        D("-5.60"),
    )
    with pytest.raises(ValueError):
        carrier_deviation(airport, precision="none")


def test_exact_and_rounded_differences(make_flights):
    # Carrier mean 1/3, airport mean 2/3: rounded 0.33 - 0.67, exact -1/3.
    flights = make_flights(
        [
            {"op_unique_carrier": c, "dep_delay": d}
            for c, d in [("AA", 1.0), ("AA", 0.0), ("AA", 0.0), ("BB", 3.0), ("BB", 0.0), ("BB", 0.0)]
        ]
    )
    first = {
        p: carrier_deviation(flights, precision=p).where("classifica = 1").first()
        for p in ("rounded", "exact")
    }
    by = {p: row.differenza for p, row in first.items()}
    assert by == {"rounded": D("-0.34"), "exact": D("-0.33")}


def test_means_of_huge_groups_are_exact(spark):
    """A mean just under a half stays under it, whatever the size of the group."""
    n = 3 * 10**10 + 1
    parts = spark.createDataFrame(
        [(D("30150000001"), n)], "total decimal(28,6), n bigint"
    )
    mean = mean_of(F.col("total"), F.col("n"))
    got = parts.select(rounded(mean).alias("r"), (mean < F.lit("1.005").cast("decimal(10,3)")).alias("under")).first()
    assert got.under and got.r == D("1.00")


def test_fractional_delays_sum_exactly_in_any_order(spark, make_flights):
    delays = [0.1, 0.2, 0.3, 1e9, -1e9, 0.005] * 20
    want = None
    for seed in range(3):
        shuffled = make_flights([{"arr_delay": d} for d in delays]).orderBy(F.rand(seed))
        got = route_month_stats(shuffled.repartition(5)).first().ritardo_medio
        assert want is None or got == want
        want = got
    assert want == D("0.10")


def test_invariants(spark, small):
    flights = flights_view(spark, small).cache()
    bands = delay_band_report(flights).agg(
        F.sum("numero_ritardi_basso") + F.sum("numero_ritardi_medio") + F.sum("numero_ritardo_alto")
    ).first()[0]
    unknown = flights.where("cancelled = 0 and dep_delay is null").count()
    cancelled = flights.where("cancelled = 1").count()
    assert bands + unknown + cancelled == flights.count()

    deviation = carrier_deviation(flights).cache()
    months = route_month_stats(flights).groupBy("aeroporto_partenza", "codice").agg(
        F.sum("numero_voli").alias("n")
    )
    joined = deviation.join(
        months.withColumnRenamed("codice", "compagnia"), ["aeroporto_partenza", "compagnia"]
    )
    assert joined.where("n <> numero_voli").count() == 0 and joined.count() == deviation.count()

    ranks = deviation.groupBy("aeroporto_partenza").agg(
        F.sort_array(F.collect_list("classifica")).alias("ranks"), F.count("*").alias("n")
    )
    assert ranks.where("ranks <> sequence(1, cast(n as int))").count() == 0
    assert airport_means(flights).count() == deviation.select("aeroporto_partenza").distinct().count()
    flights.unpersist()
    deviation.unpersist()


def test_scales_of_a_report_equal_the_report_of_each_scaled_set(spark, make_flights):
    """Identical flights tie where samples end; groups are lost in the smaller samples."""
    rows = [
        {
            "op_unique_carrier": f"C{i % 3}",
            "origin": "ABE" if i % 2 else f"X{i % 7}",
            "month": i % 2 + 1,
            "dep_delay": None if i % 11 == 0 else float(i % 90),
            "arr_delay": float(i % 7) - 2.5 if i % 5 else None,
            "cancelled": int(i % 13 == 0),
            "cancellation_code": "B" if i % 13 == 0 else None,
            "nas_delay": float(i % 4),
        }
        for i in list(range(120)) + [1] * 150
    ]
    flights = make_flights(rows).repartition(5)
    scales = (0.1, 0.25, 0.5, 1.0, 1.5, 2.25)
    sets = scaled(flights, scales)
    for report in (route_month(), delay_band(), carrier_gaps(precision="exact")):
        together = report.at_scales(flights, scales)
        assert together.columns[0] == "scale"
        for percent in (10, 25, 50, 100, 150, 225):
            one = report.of(sets.where(F.col("scale") == percent).drop("scale"))
            got = together.where(F.col("scale") == percent).drop("scale")
            assert got.schema.simpleString() == one.schema.simpleString()
            assert sorted(map(str, got.collect())) == sorted(map(str, one.collect()))
    assert route_month().at_scales(flights.limit(0), scales).count() == 0

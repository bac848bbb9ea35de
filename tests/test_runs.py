"""Run comparisons on a hand-written log."""

from decimal import Decimal

import pytest

from tarmac.operators import runs as R

# analysis, tech, pct, env, seconds, repeat
LOG = [
    ("3.1", "Hive", 100, "Locale", 12.0, 1),
    ("3.1", "Hive", 100, "Locale", 99.0, 2),
    ("3.1", "Hive", 100, "Cluster", 38.0, 1),
    ("3.2", "Hive", 100, "Locale", 40.0, 1),
    ("3.2", "Hive", 100, "Cluster", 0.0, 1),
    ("3.3", "Spark_Core", 100, "Cluster", 67.0, 1),
    ("3.3", "Spark_SQL", 100, "Locale", 700.0, 1),
    ("3.3", "Spark_SQL", 100, "Cluster", 35.0, 1),
    ("3.3", "Spark_SQL", 10, "Locale", 5.0, 1),
    ("3.3", "Spark_SQL", 10, "Cluster", 33.0, 1),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        LOG, "analysis string, tech string, pct int, env string, seconds double, repeat int"
    )


def test_pivot_keeps_one_sided_technologies(log):
    rows = {r.tech: r.asDict() for r in R.run_pivot(log).collect()}
    hive = rows["Hive"]
    assert (hive["A3.1_locale"], hive["A3.1_cluster"]) == (12.0, 38.0)
    assert hive["A3.1_speedup"] == Decimal("0.32")
    assert hive["A3.2_speedup"] is None  # divided by zero
    core = rows["Spark_Core"]
    assert (core["A3.3_locale"], core["A3.3_cluster"], core["A3.3_speedup"]) == (None, 67.0, None)


def test_speedups(log):
    got = {(r.label, r.pct): r.speedup for r in R.run_speedup(log).collect()}
    assert got == {
        ("3.1 / Hive", 100): Decimal("0.32"),
        ("3.2 / Hive", 100): None,
        ("3.3 / Spark_SQL", 100): Decimal("20.00"),
        ("3.3 / Spark_SQL", 10): Decimal("0.15"),
    }
    matrix = {r.label: (r.p10, r.p100) for r in R.speedup_matrix(log).collect()}
    assert matrix["3.3 / Spark_SQL"] == (Decimal("0.15"), Decimal("20.00"))
    seconds = {r.label: (r.p10, r.p100) for r in R.seconds_matrix(log, "Locale").collect()}
    assert seconds["3.3 / Spark_SQL"] == (5.0, 700.0) and "3.3 / Spark_Core" not in seconds


def test_mean_speedup_is_a_ratio_of_means(log):
    got = {(r.tech, r.pct): r.speedup for r in R.mean_speedup(log).collect()}
    # Hive: (12 + 99 + 40) / 3 over (38 + 0) / 2.
    assert got[("Hive", 100)] == Decimal("2.65")
    assert ("Spark_Core", 100) not in got


def test_break_even(log):
    rows = {(r.tech, r.analysis): r for r in R.break_even(log).collect()}
    assert len(rows) == 3 * 3
    assert rows[("Spark_SQL", "3.3")].p100 == "yes"
    assert rows[("Spark_SQL", "3.3")].p10 == "no"
    assert rows[("Spark_Core", "3.3")].p100 == "-"
    assert rows[("Hive", "3.3")].p100 == "-"


def test_axes_come_from_the_log(spark, log):
    more = spark.createDataFrame(
        [
            ("3.4", "Hive", 200, "Locale", 30.0, 1),
            ("3.4", "Hive", 200, "Cluster", 10.0, 1),
            ("3.4", "Hive", 100, "Locale", 8.0, 1),
        ],
        log.schema,
    )
    both = log.unionByName(more)
    hive = {r.tech: r.asDict() for r in R.run_pivot(both).collect()}["Hive"]
    assert (hive["A3.4_locale"], hive["A3.4_cluster"]) == (8.0, None)
    assert {r.label: r.p200 for r in R.speedup_matrix(both).collect()}["3.4 / Hive"] == 3
    assert {r.label: r.p200 for r in R.seconds_matrix(both, "Cluster").collect()}["3.4 / Hive"] == 10
    rows = {(r.tech, r.analysis): r for r in R.break_even(both, overhead=15.0).collect()}
    assert len(rows) == 3 * 4
    assert (rows[("Hive", "3.4")].p200, rows[("Hive", "3.4")].p100) == ("yes", "-")
    assert rows[("Spark_SQL", "3.4")].p200 == "-"


def test_environments_come_from_the_log(spark, log):
    renamed = log.replace({"Locale": "desk", "Cluster": "cloud"}, subset=["env"])
    assert R.environments_of(renamed) == ("cloud", "desk")
    assert "A3.1_desk" in R.run_pivot(renamed).columns
    third = renamed.unionByName(log)
    with pytest.raises(ValueError):
        R.run_pivot(third)
    with pytest.raises(ValueError):
        R.environments_of(log.limit(0))
    assert R.run_pivot(third, environments=("desk", "cloud")).count() == 3


def test_cells_hold_every_wide_table(log):
    known = R.reduce_runs(log)
    assert R.reduce_runs(known) is known
    cells = {(r.label, r.pct): r for r in R.run_cells(known, overhead=30.0).collect()}
    assert len(cells) == 5
    assert cells["3.3 / Spark_SQL", 100].saves == "yes" and cells["3.3 / Spark_SQL", 10].saves == "no"
    assert cells["3.3 / Spark_Core", 100].saves == "-" and cells["3.3 / Spark_Core", 100].a is None
    wide = {r.label: (r.p10, r.p100) for r in R.speedup_matrix(known).collect()}
    assert wide["3.3 / Spark_SQL"] == tuple(cells["3.3 / Spark_SQL", p].speedup for p in (10, 100))
    assert [r.asDict() for r in R.run_pivot(log).collect()] == [
        r.asDict() for r in R.run_pivot(known).collect()
    ]


def test_log_of_many_analyses(spark, log):
    """1,001 analyses: nothing is refused, and the rows agree with the wide table."""
    many = spark.range(1001).selectExpr(
        "lpad(string(id), 4, '0') as analysis", "'Hive' as tech", "100 as pct",
        "explode(array('Locale', 'Cluster')) as env", "double(id + 1) as seconds", "1 as repeat",
    )
    many = R.reduce_runs(many)
    row = R.run_pivot(many).first()
    assert len(row) == 1 + 3 * 1001 and row["A1000_locale"] == row["A1000_cluster"] == 1001.0
    cells = R.run_cells(many)
    assert cells.count() == 1001 and cells.where("a = b and speedup = 1").count() == 1001
    assert R.break_even(many).where("p100 = 'no'").count() == 1001


def test_summary_and_extremes(log):
    rows = R.run_summary(log).collect()
    assert [(r.analysis, r.tech) for r in rows][0] == ("3.3", "Spark_SQL")
    first = R.run_extremes(log).first()
    # 3.1 / Hive: mean 55.5 over 38 is 1.46.
    assert (first.best_speedup, first.best_run) == (Decimal("20.00"), "3.3 / Spark_SQL")
    assert (first.worst_speedup, first.worst_run) == (Decimal("1.46"), "3.1 / Hive")
    assert first.mean_speedup == Decimal("10.73")

"""Comparison of two results."""

from decimal import Decimal

import pytest

from tarmac.operators import checksums
from tarmac.operators import reconcile as R

SCHEMA = "k string, m int, x double, t string, d decimal(10,2)"
A = [
    ("a", 1, 1.00, "t", Decimal("1.01")),
    ("b", 1, None, "t", Decimal("1.01")),
    ("c", 1, 1.02, "t", Decimal("1.01")),
    (None, 1, 1.0, None, None),
    ("only a", 1, 1.0, "t", None),
]
B = [
    ("a", 1, 1.00, "u", Decimal("1.02")),
    ("b", 1, 0.0, "t", Decimal("1.03")),
    ("c", 1, 1.03, "t", Decimal("1.01")),
    (None, 1, 1.0, None, None),
    ("only b", 1, 1.0, "t", None),
]


@pytest.fixture
def pair(spark):
    return spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)


def test_summary(pair):
    row = R.reconcile(*pair, ["k", "m"], job="j").first()
    assert (row.job, row.rows_a, row.rows_b, row.same_length) == ("j", 5, 5, True)
    assert (row.only_a, row.only_b, row.repeated_keys) == (1, 1, 0)
    # A gap of exactly 0.01 is within tolerance, NULL against 0 is not.
    assert (row.diff_x, row.diff_t, row.diff_d) == (1, 1, 1)
    assert (row.diff_cells, row.verdict) == (3, "different keys")


def test_verdicts(pair, spark):
    a, b = pair
    keyed = ["k", "m"]
    assert R.reconcile(a, a, keyed).first().verdict == "identical"
    assert R.reconcile(a, b.limit(3), keyed).first().verdict == "different row counts"
    same = a.where("k = 'a'"), b.where("k = 'a'")
    assert R.reconcile(*same, keyed).first().verdict == "different cells"
    twice = a.unionByName(a)
    row = R.reconcile(twice, twice, keyed).first()
    assert (row.verdict, row.repeated_keys) == ("repeated keys", 5)
    empty = a.limit(0)
    assert R.reconcile(empty, empty, keyed).first().verdict == "identical"
    assert R.missing_input(spark, "j").first().verdict == "missing input"
    with pytest.raises(ValueError):
        R.reconcile(a, b.drop("x"), keyed)


def test_nan_is_missing(spark):
    a = spark.createDataFrame([(1, float("nan"))], "k int, x double")
    b = spark.createDataFrame([(1, None)], "k int, x double")
    assert R.reconcile(a, b, ["k"]).first().verdict == "identical"


def test_infinity_differs_from_missing(spark):
    a = spark.createDataFrame([(1, float("inf")), (2, float("inf"))], "k int, x double")
    b = spark.createDataFrame([(1, None), (2, float("inf"))], "k int, x double")
    assert R.reconcile(a, b, ["k"]).first().diff_cells == 1


def test_differing_cells(pair):
    got = {(r.k, r.column_name, r.value_a, r.value_b) for r in
           R.differing_cells(*pair, ["k", "m"]).collect()}
    assert got == {
        ("a", "t", "t", "u"),
        ("b", "x", None, "0.0"),
        ("b", "d", "1.01", "1.03"),
        ("only a", "(row)", "1", "0"),
        ("only b", "(row)", "0", "1"),
    }


def test_repeated_keys_are_listed(spark):
    a = spark.createDataFrame([(1, 5), (1, 9), (2, 4), (2, 4), (3, 1)], "k int, x int")
    b = spark.createDataFrame([(1, 9), (2, 4), (2, 4), (3, 1), (4, 2)], "k int, x int")
    got = {tuple(r) for r in R.differing_cells(a, b, ["k"]).collect()}
    assert got == {
        (1, "(row)", "2", "1"),
        (1, "x", "9", "9"),
        (2, "(row)", "2", "2"),
        (4, "(row)", "0", "1"),
    }
    assert R.reconcile(a, b, ["k"]).first().repeated_keys == 2


def test_rows_of_a_repeated_key_are_paired(spark):
    a = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 4, None), (None, 1, "n"), (None, 2, "n")], "k int, x int, t string")
    b = spark.createDataFrame([(1, 9, "z"), (1, 5, "x"), (1, 9, "z"), (None, 1, "n")], "k int, x int, t string")
    got = {tuple(r) for r in R.paired_cells(a, b, ["k"]).collect()}
    assert got == {
        (1, 2, "t", "y", "z"),
        (1, 3, "(row)", "0", "1"),
        (2, 1, "(row)", "1", "0"),
        (None, 2, "(row)", "1", "0"),
    }


def test_a_hot_key_is_numbered_over_several_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        hot = spark.range(5000).selectExpr("if(id < 4000, 0, id) as k", "id as v").repartition(6)
        rows = R.occurrences(hot, ["k"]).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(r.v for r in rows if r.k == 0 and r.occurrence == r.v + 1) == list(range(4000))
    assert {r.occurrence for r in rows if r.k != 0} == {1}


def test_side_by_side(pair):
    rows = R.side_by_side(*pair, ["k", "m"], n=3)
    assert rows.columns[:4] == ["k", "m", "in_locale", "in_cluster"]
    assert [(r.k, r.x_locale, r.x_cluster) for r in rows.collect()] == [
        (None, 1.0, 1.0),
        ("a", 1.0, 1.0),
        ("b", None, 0.0),
    ]


def test_one_repeated_key_is_one_group(spark):
    """A key with most of the rows must not be paired row by row."""
    hot = spark.range(20000).selectExpr("1 as k", "id as v")
    row = R.reconcile(hot, hot, ["k"]).first()
    assert (row.rows_a, row.repeated_keys, row.verdict) == (20000, 1, "repeated keys")


def test_set_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert {tuple(r) for r in R.set_difference(a, b).collect()} == {(2, 1, 0), (3, 0, 1)}
    assert {tuple(r) for r in R.set_difference(a, b, multiplicity=True).collect()} == {
        (1, 2, 1),
        (2, 1, 0),
        (3, 0, 1),
    }


def test_checksums_leave_only_parts_that_differ(spark, monkeypatch):
    """A third of the rows has one key, rows repeat, and NULL moves between columns."""
    a = spark.range(9000).selectExpr(
        "if(id % 3 = 0, 1, id % 4000) as `k.1`", "if(id % 2 = 0, id % 5, null) as x",
        "if(id % 2 = 0, null, id % 5) as y", "id % 7 as z",
    ).repartition(3)
    keys = ["k.1"]
    same = checksums.narrowed(a, a.repartition(7), keys)
    assert (same.parts, same.equal_rows, same.a.count(), same.b.count()) == (0, 18000, 0, 0)
    empty = a.limit(0)
    assert checksums.narrowed(empty, empty, keys).equal_rows == 0

    swapped = a.selectExpr("`k.1`", "if(`k.1` = 7, y, x) as x", "if(`k.1` = 7, x, y) as y", "z")
    # One row of the hot key more, one key's NULLs in another column.
    b = swapped.unionByName(a.where("`k.1` = 1 and z = 2").limit(1))
    less = checksums.narrowed(a, b, keys)
    assert less.parts == 2 and less.equal_rows + less.a.count() + less.b.count() == 18001

    def rows(df):
        return sorted(map(str, df.collect()))

    cells = rows(R.paired_cells(a, b, keys))
    assert cells and rows(R.paired_cells(a, b, keys, checksums=True)) == cells
    difference = rows(R.set_difference(a, b, multiplicity=True))
    assert difference
    assert rows(R.set_difference(a, b, multiplicity=True, checksums=True)) == difference
    # Further levels, and more differing parts than one filter lists.
    monkeypatch.setattr(checksums, "MANY_ROWS", 0)
    assert rows(R.paired_cells(a, b, keys, checksums=True)) == cells
    other = a.selectExpr("`k.1`", "x", "y", "z + 1 as z")
    assert checksums.narrowed(a, other, keys).parts > 256
    whole = rows(R.set_difference(a, other))
    assert rows(R.set_difference(a, other, checksums=True)) == whole
    with pytest.raises(ValueError):
        R.paired_cells(a, b.drop("z"), keys, checksums=True)

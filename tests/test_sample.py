"""Samples are exact, reproducible and equal to sorting by hash."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarmac.operators import sample


def md5_order(values, seed=42):
    return sorted(values, key=lambda v: hashlib.md5(f"{seed}|{v}".encode()).hexdigest())


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(5001).withColumn("text", F.concat(F.lit("t"), F.col("id") % 7))


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9999, 1.0])
def test_equals_sorting_by_hash(numbers, fraction):
    got = {r.id for r in sample.exact_sample(numbers, fraction, key=["id"]).collect()}
    assert got == set(md5_order(range(5001))[: round(fraction * 5001)])


def test_smaller_samples_lie_in_larger_and_seeds_differ(numbers):
    def ids(fraction, seed=42):
        return {r.id for r in sample.exact_sample(numbers, fraction, ["id"], seed).collect()}

    assert ids(0.1) < ids(0.25) < ids(0.75)
    assert ids(0.5) != ids(0.5, seed=7)


def test_partitioning_does_not_matter(numbers):
    a = sample.exact_sample(numbers, 0.3, ["id"])
    b = sample.exact_sample(numbers.repartition(13, "text"), 0.3, ["id"])
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_deep_ranges_are_narrowed_step_by_step(numbers, monkeypatch):
    monkeypatch.setattr(sample, "STEP", 1)
    monkeypatch.setattr(sample, "SMALL_RANGE", 10)
    got = {r.id for r in sample.exact_sample(numbers, 0.37, key=["id"]).collect()}
    assert got == set(md5_order(range(5001))[: round(0.37 * 5001)])


def test_a_row_that_is_a_third_of_all(spark):
    """Identical rows tie on every hash; the sample still has the exact size."""
    hot = spark.range(3000).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    cold = spark.range(6000).select(
        F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v")
    )
    df = hot.unionByName(cold)
    order = md5_order([("hot|1")] * 3000 + [f"{i}|{i}" for i in range(6000)])
    for fraction in (0.05, 0.2, 0.4, 0.6, 0.8):
        want = Counter(t.split("|")[0] for t in order[: round(fraction * 9000)])
        got = Counter(r.k for r in sample.exact_sample(df, fraction).collect())
        assert got == want


def test_a_key_that_is_a_third_of_all(spark):
    """Different rows under one key are told apart by the hash of the whole row."""
    df = spark.range(9000).select(
        F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("v"),
    )
    sizes = set()
    for fraction in (0.05, 0.2, 0.4, 0.6, 0.8):
        rows = sample.exact_sample(df, fraction, key=["k"]).collect()
        assert len(rows) == len({r.v for r in rows}) == round(fraction * 9000)
        sizes.add(sum(r.k == "hot" for r in rows))
    assert any(0 < s < 3000 for s in _hot_shares(df))
    assert sizes <= set(range(3001))


def _hot_shares(df):
    """Hot rows in samples cut at many sizes: some cut must fall inside the hot key."""
    for fraction in [i / 12 for i in range(1, 12)]:
        yield sample.exact_sample(df, fraction, key=["k"]).where("k = 'hot'").count()


def test_copies_are_made_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sample, "COPY_BLOCK", 7)
    df = spark.range(100).select(F.lit(1).alias("v"))
    assert sample.exact_sample(df, 0.33).count() == 33


def test_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None)], "k string, v int")
    assert sample.exact_sample(df, 0.67).count() == 2
    assert sample.exact_sample(df.limit(0), 0.5).count() == 0


def test_oversample_holds_each_row_once_or_twice(numbers):
    copies = sample.oversample(numbers, 0.5, key=["id"]).groupBy("id").count()
    got = Counter(r["count"] for r in copies.collect())
    assert got == {1: 5001 - round(0.5 * 5001), 2: round(0.5 * 5001)}


def test_oversample_by_more_than_the_whole(numbers):
    copies = sample.oversample(numbers, 1.5, key=["id"]).groupBy("id").count()
    got = Counter(r["count"] for r in copies.collect())
    assert got == {2: 5001 - round(0.5 * 5001), 3: round(0.5 * 5001)}
    assert sample.oversample(numbers, 1.0, key=["id"]).count() == 2 * 5001
    with pytest.raises(ValueError):
        sample.oversample(numbers, -0.5)


def test_labels_are_whole_and_different(numbers):
    sizes = sample.scaled(numbers, (0.28, 0.29, 0.57), key=["id"]).groupBy("scale").count()
    got = {r.scale: r["count"] for r in sizes.collect()}
    assert got == {p: round(p / 100 * 5001) for p in (28, 29, 57)}
    for wrong in ((0.5, 0.5), (0.125,), (0.0,)):
        with pytest.raises(ValueError):
            sample.scaled(numbers, wrong)


def test_copies_of_a_hot_row_run_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sample, "COPY_BLOCK", 50)
    hot = spark.range(4000).select(F.lit(1).alias("v"))
    for strata in (None, ["v"]):
        picked = sample.exact_sample(hot, 0.5, strata=strata)
        tasks = picked.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in tasks) == 2000 and len(tasks) >= 4


def test_strata_meet_stored_cuts_only(spark, small):
    from tarmac.sources.tables import load

    orders = load(spark, small, "orders")
    picked = sample.exact_sample(
        orders, 0.25, key=["o_orderkey"], strata=["o_orderpriority"]
    )
    text = picked._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 2 and "Exchange hashpartitioning" not in text


def test_oversample_of_identical_rows(spark):
    df = spark.range(1001).select(F.lit("x").alias("v"))
    assert sample.oversample(df, 0.5).count() == 1001 + round(0.5 * 1001)


def test_scaled_equals_the_single_samples(numbers):
    everything = sample.scaled(numbers, key=["id"])
    for scale in (10, 25, 50, 75):
        one = sample.exact_sample(numbers, scale / 100, key=["id"])
        part = everything.where(F.col("scale") == scale).drop("scale")
        assert part.exceptAll(one).count() == 0 and part.count() == one.count()
    sizes = {r.scale: r["count"] for r in everything.groupBy("scale").count().collect()}
    assert sizes[100] == 5001 and sizes[150] == 5001 + round(0.5 * 5001)


def test_scaled_with_identical_rows(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("v"))
    sizes = {r.scale: r["count"] for r in sample.scaled(df).groupBy("scale").count().collect()}
    assert sizes == {10: 50, 25: 125, 50: 250, 75: 375, 100: 500, 150: 750}


def test_strata(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2003, None).otherwise(
            (F.col("id") % 5).cast("string")
        ).alias("s"),
        "id",
    )
    sizes = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    for key in (None, ["id"], ["s"]):
        picked = sample.exact_sample(df, 0.5, key=key, strata=["s"])
        got = {r.s: r["count"] for r in picked.groupBy("s").count().collect()}
        assert got == {s: round(0.5 * n) for s, n in sizes.items()}
        assert picked.distinct().count() == picked.count()


def test_strata_of_identical_rows(spark):
    df = spark.range(600).select((F.col("id") % 3).alias("s"), F.lit(1).alias("v"))
    got = sample.exact_sample(df, 0.25, strata=["s"]).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {0: 50, 1: 50, 2: 50}


def test_shuffled_order_is_reproducible(numbers):
    got = [r.id for r in sample.shuffled(numbers, key=["id"]).limit(50).collect()]
    assert got == md5_order(range(5001))[:50]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_all_rows_have_their_place_in_the_shuffled_order(spark, numbers, coalesce):
    """Sorted by one task, and by several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        mixed = sample.shuffled(numbers.withColumn("place", F.lit(-1)), key=["id"])
        rows = sample.numbered(mixed).collect()
    finally:
        spark.conf.set(name, before)
    rows.sort(key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(5001))
    assert [r.id for r in rows] == md5_order(range(5001))
    assert sample.numbered(sample.shuffled(numbers.limit(0))).collect() == []


@pytest.fixture
def split(spark, monkeypatch):
    """Sorts keep their tasks, and few copies of a row are many."""
    monkeypatch.setattr(sample, "COPY_BLOCK", 50)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_tied_keys_have_one_order_however_the_rows_are_dealt(spark, split):
    rows = [(i % 3, i // 2 % 500) for i in range(3000)]
    orders = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "k int, v int").repartition(n)
        placed = sample.numbered(sample.shuffled(df, key=["k"])).collect()
        orders.append([(r.k, r.v) for r in sorted(placed, key=lambda r: r.place)])
    assert orders[0] == orders[1] and sorted(orders[0]) == sorted(rows)


@pytest.mark.parametrize("key", [["k"], None])
def test_a_hot_hash_lies_in_several_tasks(spark, split, key):
    same = spark.range(4000).selectExpr("1 as k", "if(id < 2500, 0, id) as v")
    out = sample.shuffled(same, key=key).withColumn("task", F.spark_partition_id())
    tasks = {r.task: r.n for r in out.where("v = 0").groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert sum(tasks.values()) == 2500 and len(tasks) >= 3 and max(tasks.values()) < 1500


@pytest.mark.parametrize("key", [["_key"], None])
@pytest.mark.parametrize("copies", [1, 300])
def test_the_sort_compares_stored_hashes(spark, split, key, copies):
    """No hash is computed in a comparison, and own columns of the hashes' names are kept."""
    df = spark.range(400).selectExpr("id % 5 as _key", f"if(id < {copies}, 0, id) as _row")
    mixed = sample.shuffled(df, key=key)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert sorts and not any("md5" in line for line in sorts)

    def order(row):
        of_key = [hashlib.md5(f"42|{row[0]}".encode()).hexdigest()] if key else []
        return *of_key, hashlib.md5(f"42|{row[0]}|{row[1]}".encode()).hexdigest()

    rows = [(i % 5, 0 if i < copies else i) for i in range(400)]
    placed = sorted(sample.numbered(mixed).collect(), key=lambda r: r.place)
    assert [(r._key, r._row) for r in placed] == sorted(rows, key=order)


def test_the_whole_shuffle_is_registered(spark, small):
    from tarmac.checks.registry import QUERIES

    orders = spark.read.parquet(f"{small}/orders.parquet")
    assert QUERIES["shuffled_orders"](spark, small).count() == orders.count() > 100


def test_fraction_is_checked(numbers):
    with pytest.raises(ValueError):
        sample.exact_sample(numbers, 1.2)


def test_a_sample_is_a_plain_filter(numbers):
    plan = sample.exact_sample(numbers, 0.25, key=["id"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()

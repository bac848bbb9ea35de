"""Water-filling and the seeded selection."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import mixing


def brute_targets(sizes, weights, budget, epochs=2):
    """Exact water-filling by trying every set of capped sources in order of need."""
    open_ = set(sizes)
    target = {}
    left = Fraction(budget)
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def docs_of(spark, groups):
    rows = [(i * 1000 + k, "w " * n, s) for i, (s, ns) in enumerate(groups.items()) for k, n in enumerate(ns)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=12), min_size=1, max_size=7))
def test_targets_equal_exact_water_filling(spark, groups):
    named = {f"s{i}": ns for i, ns in enumerate(groups)}
    rows = mixing.mix_digest(docs_of(spark, named)).collect()
    sizes = {s: sum(ns) for s, ns in named.items()}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(named))}
    want = brute_targets(sizes, weights, Fraction(3 * sum(sizes.values()), 2))
    taken = dict.fromkeys(named, 0)
    for r in rows:
        source = f"s{r.doc_id // 1000}"
        assert r.target == pytest.approx(float(want[source])) and r.taken <= 2 * r.size
        taken[source] += r.taken
    for s, ns in named.items():
        # Half of the document in which the target ends, at most.
        assert abs(taken[s] - want[s]) <= Fraction(max(ns), 2) + Fraction(1, 1000)


def test_weights_follow_code_points_and_null_is_last(spark):
    names = ["b", None, "B", "é", "a", "\U0001f600", "￿"]
    docs = spark.createDataFrame([(n,) for n in names], "source string")
    got = {r.source: r.weight for r in mixing.repeating_weights(docs, (3, 1, 2)).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n])
    assert got == {n: (3, 1, 2)[i % 3] for i, n in enumerate([*order, None])}


def test_reruns_agree_and_rows_repeat(spark):
    docs = docs_of(spark, {"a": [5] * 40, "b": [7] * 30, "c": [1000], None: [3] * 9})
    first = sorted(map(tuple, mixing.mix_digest(docs).collect()))
    assert first == sorted(map(tuple, mixing.mix_digest(docs.repartition(7)).collect()))
    copies = {r[0]: r[5] for r in first}
    mixed = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {d: n for d, n in copies.items() if n}


EQUAL = ["w " * 10] * 100


@pytest.mark.parametrize("ids, texts", [([None, 7] * 50, EQUAL), ([7] * 100, [f"{i % 9} " * 10 for i in range(100)])])
def test_null_and_equal_ids_meet_the_target(spark, ids, texts):
    rows = [(i, t, "a") for i, t in zip(ids, texts)] + [(1000 + i, "w " * 10, "b") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(5)
    got = mixing.mix_digest(docs).collect()
    assert len(got) == 111
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5.001
        assert all(r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(docs.repartition(3)).collect()))
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)


def test_columns_of_any_name_stay_or_are_replaced(spark):
    rows = [(1, "a b", "s", 5, 6), (None, "a b", "s", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, `a.b` int, Target int")
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "a.b", "source_size", "target", "repetition"]
    assert {r["a.b"] for r in out.collect()} == {5}

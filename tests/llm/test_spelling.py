"""Spelling variants against comparisons of all words."""

import random
import zlib
from collections import Counter

import compare
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.llm import spelling
from tarmac.llm.oracle import ORACLE_SQL
from tarmac.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts):
    rows, forms = {}, {}
    for w, n in counts.items():
        near = sorted((-counts[x], x) for x in counts if x != w and one_edit(w, x))
        if near and -near[0][0] >= 10 * n:
            forms[w] = near[0][1]
        rows[w] = (n, len(near))
    found = set()
    for w, (n, n_near) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        found.add((w, form, root, n, n_near, counts[form] if form else None))
    return found


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = regex.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += len(word) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def rows_of(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {tuple(r) for r in spelling.variant_groups(words).collect()}


def test_all_pairs_of_a_dense_vocabulary(spark):
    rng = random.Random(7)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(900)}
    counts = {w: rng.choice([2, 5, 25, 300, 4000]) for w in words}
    assert rows_of(spark, counts) == brute_force(counts)


def test_long_words_and_long_common_parts(spark):
    stem = "".join(random.Random(1).choices("abcdefgh", k=3000))
    words = [stem, stem[:-1], stem[:1500] + stem[1501:], "x" + stem, stem[:700] + "z" + stem[701:]]
    words += ["a" * n for n in range(7, 20)] + ["a" * 10 + "b" + "a" * k for k in range(5)]
    counts = {w: 2 + 11 ** (i % 4) for i, w in enumerate(dict.fromkeys(words))}
    assert rows_of(spark, counts) == brute_force(counts)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("ab", min_size=1, max_size=6), st.integers(2, 400), min_size=1, max_size=60))
def test_any_vocabulary(spark, counts):
    assert rows_of(spark, counts) == brute_force(counts)


def test_forms_lead_to_roots_over_many_links(spark):
    words = ["aaaaaaa" + "b" * k for k in range(9)]
    counts = {w: 2 * 10**k for k, w in enumerate(words)}
    got = {r[0]: r[2] for r in rows_of(spark, counts)}
    assert set(got.values()) == {words[-1]}


def test_words_of_awkward_texts(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "Straßen-Übergänge ÜBERGÄNGE übergänge Übergänge"),
        (3, "Straßen-Übergänge ÜBERGÄNGE übergänge Übergänge"),
        (None, "wordwordx wordwordx wordwordĀrest İstanbul wordword1wordword"),
        (4, "q" * 400_000),
        (5, "q" * 400_000),
        (6, "q" * 399_999),
        (7, "q" * 399_999),
    ]
    for i in range(300):
        rows.append((100 + i, f"commonword commonwords other{'abcdefghij'[i % 10]}word"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit(1) for c in ("a.b", "Word", "n", "way")}
    )
    got = {tuple(r) for r in spelling.spelling_digest(docs).collect()}
    assert got == brute_force(words_of(rows))
    assert spelling.spelling_digest(docs.limit(0)).collect() == []
    assert spelling.spelling_digest(docs.where("doc_id = 1")).collect() == []


def test_query_equals_brute_force_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.word: r.n for r in QUERIES["op11_spelling"](spark, small).collect()}
    assert got == words_of([tuple(r) for r in docs])


def test_query_equals_sql(spark, small):
    df, sql = QUERIES["op11_spelling"](spark, small), ORACLE_SQL["op11_spelling"]
    con = compare.connect(small)
    assert compare.kinds(df) == compare.oracle_kinds(con, sql)
    assert compare.spark_rows(df) == compare.oracle_rows(con, sql)

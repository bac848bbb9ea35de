"""The trie of conversations against one built with dictionaries."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import compare
import pytest
from pyspark.sql import functions as F

from tarmac.llm import prefix_trie
from tarmac.llm.oracle import ORACLE_SQL
from tarmac.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(found)] for c, found in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        taken = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:taken] + own[taken:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    found = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        inner = {p[:-1] for p in below if len(p) > len(path)}
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == path)
        parent = min(members[path[:-1]]) if path else None
        leaves = len(below) - len(inner)
        digest = sha256(ends.encode()).hexdigest()
        row = (min(convs), len(path), parent, len(convs), len(children), leaves, saved, digest)
        assert row not in found
        found.add(row)
    return found


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def conversations(seed, n, longest, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["é", "b", "cc"][:words])))
    return rows


@pytest.mark.parametrize("height", [None, 1, 2, 3])
def test_trie_equals_brute_force(spark, height):
    rows = conversations(1, 60, 9)
    got = {tuple(r) for r in prefix_trie.trie(made(spark, rows), height).collect()}
    assert got == brute_force(rows)


def test_deep_conversations_roll_up_over_many_bands(spark):
    rows = conversations(2, 12, 14, words=1)
    for c, length in ((100, 40), (105, 43), (101, 40), (102, 70)):
        rows += [(c, t, "user", "x") for t in range(length)]
    got = {tuple(r) for r in prefix_trie.trie(made(spark, rows), 4).collect()}
    assert got == brute_force(rows)


def test_a_hot_conversation_is_hashed_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 60_000, 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = prefix_trie.trie(made(spark, rows).repartition(4)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    leaf = next(r for r in got if r.depth == 1)
    ids = [c for c in range(0, 60_000, 5)]
    assert leaf.n_convs == len(ids)
    assert leaf.ends_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_awkward_rows(spark):
    long = "y" * 3_000_000
    rows = [
        (5, None, None, "null turn first"),
        (5, 0, "user", None),
        (5, 0, "user", None),
        (6, 1, "user", "later"),
        (6, 0, "user", long),
        (None, 0, "user", "no conversation"),
        (7, 0, None, None),
        (8, 0, "", ""),
        (11, 0, "user", "base is absent"),
        (-4, 0, "user", "below zero"),
        (-5, 0, "user", long),
    ]
    wide = made(spark, rows).withColumns({c: F.lit(1) for c in ("a.b", "Depth", "hi", "n_convs")})
    signed = lambda c: c - int(c / 5) * 5
    assert signed(-4) == -4
    got = {tuple(r) for r in prefix_trie.trie(wide).collect()}
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    got_positive = {tuple(r) for r in prefix_trie.trie(made(spark, positive)).collect()}
    assert got_positive == brute_force(positive)
    assert len(got) >= len(got_positive)
    assert prefix_trie.trie(made(spark, [])).collect() == []
    assert prefix_trie.trie(made(spark, [(None, 0, "a", "b")])).collect() == []


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = brute_force([tuple(r) for r in rows.collect()])
    got = {tuple(r) for r in QUERIES["op12_prefix_trie"](spark, small).collect()}
    assert got == want


def test_query_equals_sql(spark, small):
    df, sql = QUERIES["op12_prefix_trie"](spark, small), ORACLE_SQL["op12_prefix_trie"]
    con = compare.connect(small)
    assert compare.kinds(df) == compare.oracle_kinds(con, sql)
    assert compare.spark_rows(df) == compare.oracle_rows(con, sql)

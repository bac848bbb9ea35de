"""Byte-level encoding against the library whose results it has to give, and round trips."""

import base64
import hashlib
import random
import re
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.llm import byte_bpe
from tarmac.llm.queries import QUERIES, RANKS

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    lines = (line.split() for line in Path(PATH).read_bytes().splitlines())
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.vocabulary(Path(PATH).read_bytes(), PATTERN)


def test_query_equals_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        numbers = ",".join(map(str, ids)).encode()
        whole = hashlib.sha256((r.text or "").encode()).hexdigest()
        want[r.doc_id] = (len(ids), hashlib.sha256(numbers).hexdigest(), whole)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("name", [r"\p{L}", r"\p{N}", r"\s"])
def test_character_classes_are_those_of_the_library(name):
    single = {bytes([b]): b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    members = re.findall(byte_bpe.spelled_out(name, 0x10FFFF), every)
    assert bytes(probe.encode_ordinary(every)).decode() == "".join(members)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'stre lv \n\t0é漢\U0001f600"), max_size=60) | st.text(max_size=40))
def test_any_text_equals_library_and_comes_back(own, library, text):
    text = text.encode(errors="ignore").decode()
    ids = own.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    joined, _ = own.decode(byte_bpe.pa.array(ids))
    assert joined.to_pybytes()[: len(text.encode())] == text.encode()


def test_ties_go_to_the_left_and_stale_entries_are_skipped():
    def lines(*tokens):
        return b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))

    tokens = [b"a", b"b", b"c", b"bc", b"ab", b"aa", b"aabc"]
    own = byte_bpe.Vocabulary(lines(*tokens), PATTERN)
    assert own.merged(b"aaa") == [5, 0]
    assert own.merged(b"abc") == [0, 3]
    assert own.merged(b"aabcb") == [6, 1]


def test_very_long_pre_tokens(own, library):
    rng = random.Random(5)
    for text in ("a" * 50_000, "ab" * 30_000, " " * 70_000, "".join(rng.choices("abcdeü", k=60_000))):
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_a_small_memory_of_pieces_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HELD", 10)
    monkeypatch.setattr(byte_bpe, "SLICE", 7)
    text = "one two three one two four's 12345 !? " * 30
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_awkward_rows_and_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "hé llo", "z"), (None, "hé llo", "z"), (3, "w " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `IDS` string").withColumn("a.b", F.lit(1))
    out = byte_bpe.decoded(byte_bpe.encoded(docs, PATH, PATTERN), PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    both = byte_bpe.round_trip(docs, PATH, PATTERN)
    assert both.columns == out.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, out.collect()))
    assert byte_bpe.byte_bpe_digest(docs, PATH, PATTERN).count() == len(rows)
    assert byte_bpe.byte_bpe_digest(docs.limit(0), PATH, PATTERN).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decoded(lists, PATH, PATTERN).collect()] == [b"", b"", b"!"]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decoded(spark.createDataFrame([([70_000],)], "ids array<int>"), PATH, PATTERN).collect()

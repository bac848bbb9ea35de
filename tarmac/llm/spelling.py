"""Spelling variants: words one edit apart, found in a trie kept as a table of edges.

The frontier is a table of states (word, position, node, edits). Every step joins it with the
edge table and takes each state one edge further, until no state is left; states with one edit
that end where a word ends are neighbours.

Two words one edit apart share all that lies before the edit, or all that lies behind it, to
at least half their length. So there are two tries, one of words and one of words read
backwards, and a word enters each only from the half on: its states without an edit are the
nodes of its own path, known without a step, and the short beginnings that many words share
never become states. An edit is made where the two words part, by taking another edge than the
word's own: its character replaces the word's, or is inserted before it. From there on the rest
has to match, so a state lives only as long as another word goes on with the same characters;
an edge also knows, as two masks of 64 bits, which rests occur below it, and a state whose rest
surely does not is not made. A deletion is the insertion seen from the other word, and only one
of two characters replaces the other, so each pair is found from one side and then turned round.

An edge is one character. Where 16 or more characters are left, an edge of a power of two of
them leads on from each place that this power divides, so a word of any length is walked in a
number of steps that grows with the logarithm of its length.

The edge table is written once, in buckets by node, so a step shuffles the frontier only. A
node has at most one edge per character, so the first join has rows of one key on one side only,
the words with a common half; adaptive execution splits them. Nodes are 64-bit hashes, kept
apart by way; a pair is kept only if the word that was reached is in the vocabulary.

Defined cases: a null text has no words. A null document id counts as empty text. Repeated
rows count as often as they occur. Equal counts go by code point. Texts and words of any length
are read whole. An empty table, or one without repeated words, gives an empty table. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import ascii_lower, map_arrow, stored
from tarmac.session import scratch_path

# Rows of one output batch of the workers; the shortest edge of several characters; the
# longest word that its rows repeat, a longer one is named by a hash and joined when needed.
BATCH, JUMP, SHORT = 1 << 15, 16, 64
# Rests are hashed as numbers in this base, modulo a prime.
BASE, PRIME = 1_000_003, (1 << 61) - 1

LETTERS = r"[A-Za-zÀ-ÿ]"
# One run in so many loses a character.
SLIP = 31


def word_counts(
    docs: DataFrame, least_chars: int = 7, least_n: int = 2, slip: int | None = None
) -> DataFrame:
    """``word, n``: lower-cased runs of letters and how often they occur.

    With ``slip``, a run whose checksum with its document's id it divides loses one character.
    """
    # A run of enough letters starts where any run does, so only these are taken.
    pattern = f"{LETTERS}{{{least_chars},}}"
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = docs.select(key.alias("key"), F.explode(runs).alias("run"))
    found = found.select("key", ascii_lower(F.col("run")).alias("word"))
    if slip:
        sum_ = F.crc32(F.concat_ws(":", "key", "word").cast("binary"))
        at = (F.col("sum") % F.char_length("word")).cast("int")
        rest = F.substr("word", at + 2, F.char_length("word"))
        shorter = F.concat(F.substr("word", F.lit(1), at), rest)
        found = found.withColumn("sum", sum_).select(
            F.when(F.col("sum") % slip == 0, shorter).otherwise(F.col("word")).alias("word")
        )
        found = found.where(F.char_length("word") >= least_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _rests(read: str, start: int) -> list[int]:
    """Hashes of what is left of ``read`` from every place from ``start`` on."""
    hashed = [1]
    for character in reversed(read[start:]):
        hashed.append((hashed[-1] * BASE + ord(character)) % PRIME)
    hashed.reverse()
    return hashed


def _bits(rest: int) -> tuple[int, int]:
    """Two bits of a rest, out of 64 each."""
    return rest & 63, rest >> 20 & 63


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _jump(place: int, left: int) -> int:
    """Characters of the edge from ``place`` when ``left`` are to come."""
    step = min(place & -place, 1 << (left.bit_length() - 1)) if left else 0
    return step if step >= JUMP else 1


EDGE = "node long, next long, child long, ends boolean, mask long, other_mask long"
# ``bits`` holds the way and, in six bits each, the two bits of what is left and those of what is
# left behind the next character.
START = "word string, pos int, n_chars int, node long, next int, bits int"
_UNPACKED = {
    "way": "bits & 1",
    "bit": "shiftright(bits, 1) & 63",
    "other_bit": "shiftright(bits, 7) & 63",
    "next_bit": "shiftright(bits, 13) & 63",
    "next_other_bit": "shiftright(bits, 19) & 63",
}


def _rows(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """The edges of every word from its half on, in both tries, or its states without an edit.

    ``next`` is the edge's character, or the hash of its characters; -1 at the end of the word.
    """
    from xxhash import xxh3_64, xxh64_intdigest

    i, l = pa.int32(), pa.int64()  # noqa: E741
    if edges:
        names, kinds = EDGE, [l, l, l, pa.bool_(), l, l]
    else:
        names, kinds = START, [pa.string(), i, i, l, i, i]
    names = [n.split()[0] for n in names.split(", ")]

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows: list[tuple] = []
    for batch in batches:
        for word in batch.column(0).to_pylist():
            last = len(word)
            start = (last - 1) // 2 if edges else last // 2
            for way in (0, 1):
                read = word[::-1] if way else word
                first = start if edges or not way else last - start
                rests = _rests(read, first)
                # The way is part of what is hashed: with seeds, short beginnings collide.
                running = xxh3_64(b"<>"[way : way + 1] + read[:first].encode())
                nodes = [_signed(running.intdigest())]
                for character in read[first:]:
                    running.update(character.encode())
                    nodes.append(_signed(running.intdigest()))
                name = read if last <= SHORT else long_name(word)
                for pos in range(first, last + (not edges)):
                    at = pos - first
                    a, b = _bits(rests[at])
                    if edges:
                        steps = {1, _jump(pos, last - pos)} if last - pos >= JUMP else (1,)
                        for step in steps:
                            key = ord(read[pos])
                            if step > 1:
                                # As Spark hashes a string, and below zero, apart from characters.
                                key = _signed(xxh64_intdigest(read[pos : pos + step].encode(), 42) | 1 << 63)
                            a, b = _bits(rests[at + step])
                            masks = _signed(1 << a), _signed(1 << b)
                            rows.append((nodes[at], key, nodes[at + step], pos + step == last, *masks))
                    else:
                        c, d = _bits(rests[at + 1]) if pos < last else (0, 0)
                        own = ord(read[pos]) if pos < last else -1
                        packed = way | a << 1 | b << 7 | c << 13 | d << 19
                        rows.append((name, pos, last, nodes[at], own, packed))
                    if len(rows) >= BATCH:
                        yield result(rows)
                        rows = []
        if rows:
            yield result(rows)
            rows = []


def long_name(word: str) -> str:
    """What stands for a long word, which no word of letters can be."""
    from xxhash import xxh3_128_hexdigest

    return "\0" + xxh3_128_hexdigest(word.encode())


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(0).to_pylist()
        named = pa.array([long_name(w) for w in found], pa.string())
        yield pa.RecordBatch.from_arrays([named, batch.column(0)], ["name", "whole"])


# Characters of the edge to take, as ``_jump`` has them; ``pos`` of the word are behind, and in
# the trie one more after an insertion.
_LEFT = "n_chars - pos"
_PLACE = "(pos + 1 - replaced)"
_STEP = f"least({_PLACE} & -{_PLACE}, shiftleft(1, char_length(bin({_LEFT})) - 1))"
_STEP = f"if({_STEP} >= {JUMP}, {_STEP}, 1)"
_TAKEN = "substr(read, pos + 1, step)"
_KEY = f"if(step = 1, cast(ascii({_TAKEN}) as bigint), xxhash64({_TAKEN}) | shiftleft(1L, 63))"
# The rest of the word, after an insertion or a replacement, may occur below the edge.
_MAY_REST = "(mask & shiftleft(1L, {bit})) <> 0 and (other_mask & shiftleft(1L, {other_bit})) <> 0"
_INSERTS = _MAY_REST.format(**_UNPACKED)
_REPLACES = "s.next >= 0 and s.next < e.next and " + _MAY_REST.format(
    bit=_UNPACKED["next_bit"], other_bit=_UNPACKED["next_other_bit"]
)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: all pairs of different words one inserted, deleted or replaced code point
    apart, both ways round.

    ``words`` has distinct, non-empty words in ``word``.
    """
    spark, words = words.sparkSession, words.select("word")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = (
        map_arrow(words, partial(_rows, edges=True), EDGE)
        # Dealt as the buckets are, so each of them is one file, in order.
        .repartition(buckets, "node")
        .groupBy("node", "next")
        .agg(
            F.min("child").alias("child"),
            F.max("ends").alias("ends"),
            F.bit_or("mask").alias("mask"),
            F.bit_or("other_mask").alias("other_mask"),
        )
    )
    table, path = f"spelling_edges_{uuid.uuid4().hex}", scratch_path(spark, "spelling-edges")
    edges.write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(table)
    try:
        found = _frontier(words, spark.read.schema(edges.schema).parquet(path), spark.table(table))
    finally:
        spark.sql(f"DROP TABLE {table}")
    near = F.expr("concat(left(read, at), character, substr(read, at + 1 + replaced))")
    turned = [F.when(F.col("way") == 1, F.reverse(c)).otherwise(c) for c in (F.col("read"), near)]
    pairs = found.select(turned[0].alias("word"), turned[1].alias("near")).distinct()
    both = F.array(
        F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))
    )
    # The word is one of the vocabulary; what its hash led to has to be one, too.
    known = words.withColumnRenamed("word", "near")
    return pairs.join(known, "near", "left_semi").select(F.inline(both))


def _frontier(words: DataFrame, edges: DataFrame, bucketed: DataFrame) -> DataFrame:
    """States with one edit that end where a word ends."""
    start = map_arrow(words, partial(_rows, edges=False), START)
    other = (F.col("s.node") == F.col("e.node")) & (F.col("s.next") != F.col("e.next"))
    # Edges of several characters have keys below zero; a state without an edit takes none.
    met = start.alias("s").join(edges.where("next >= 0").alias("e"), other)
    kinds = F.expr(f"array_compact(array(if({_INSERTS}, 0, null), if({_REPLACES}, 1, null)))")
    kept = ["way", "at", "replaced", "character", "n_chars", "node", "ends"]
    states = met.select(
        "word",
        F.expr(_UNPACKED["way"]).alias("way"),
        F.col("pos").alias("at"),
        F.explode(kinds).alias("replaced"),
        F.decode(F.unhex(F.lpad(F.hex("e.next"), 8, "0")), "UTF-32").alias("character"),
        "n_chars",
        F.col("child").alias("node"),
        "ends",
    )
    states = states.select("word", F.expr("at + replaced as pos"), *kept)
    states = stored(states, "spelling-frontier")
    # Long words are named in their rows; what is left of them is looked up once.
    whole = words.where(F.char_length("word") > SHORT)
    whole = map_arrow(whole, _named, "name string, whole string")
    named = F.startswith("word", F.lit("\0"))
    read = F.when(F.col("way") == 1, F.reverse("whole")).otherwise(F.col("whole"))
    states = states.where(~named).withColumnRenamed("word", "read").unionByName(
        states.where(named).join(whole, F.col("word") == F.col("name")).select(read.alias("read"), "pos", *kept)
    )
    rounds = []
    while True:
        rounds.append(states.where("ends and pos = n_chars"))
        ahead = states.where("pos < n_chars")
        if ahead.isEmpty():
            break
        ahead = ahead.withColumn("step", F.expr(_STEP)).withColumn("next", F.expr(_KEY)).drop("ends")
        # An equality that is no key of the join, so that the buckets by node serve it.
        same = (F.col("s.node") == F.col("e.node")) & (F.col("s.next").bitwiseXOR(F.col("e.next")) == 0)
        further = ahead.alias("s").join(bucketed.alias("e"), same)
        moved = [c for c in kept if c not in ("node", "ends")]
        states = stored(
            further.select("read", F.expr("cast(pos + step as int) as pos"), *moved, F.col("child").alias("node"), "ends"),
            "spelling-frontier",
        )
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the ``word, n`` of ``words``.

    A word's form is its most frequent neighbour (the smallest by code point among equals) if
    that is at least ``ratio`` times as frequent; its root is where forms lead.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    pairs = near_words(words)
    others = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        pairs.join(others, "near")
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"),
        )
    )
    known = words.join(best, "word", "left")
    chosen = -F.col("best.minus") >= ratio * F.col("n")
    forms = stored(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"),
            F.when(chosen, -F.col("best.minus")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(forms.where("form is not null").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: links followed to the last. Every round doubles the links followed; a
    form is ``ratio`` times as frequent as its word, so there are few."""
    links = stored(links, "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = stored(links.join(onward, "root", "left"), "spelling-roots")
        if doubled.where("further is not null").isEmpty():
            return links
        links = doubled.select("word", F.coalesce("further", "root").alias("root"))


def spelling_digest(docs: DataFrame) -> DataFrame:
    """Variant groups of the words of all documents, of which some have lost a character."""
    return variant_groups(word_counts(docs, slip=SLIP))

"""Prefix trie of conversations.

A node is a distinct sequence of first turns; the conversations that begin with it are its
members. Nodes are told apart by their depth and 128 bits: the exclusive or, over the turns,
of two 64-bit hashes of a turn's place, role and text. So every prefix of a conversation is a
running aggregate, without a fold over texts and without a round per depth, and no text is
shuffled.

Totals of subtrees roll up in depth bands of a fixed height. A node is exploded to its
ancestors inside its band only, at most ``height`` of them, and one aggregation sums all bands
at once. Then the completed totals of the bands' topmost nodes pass from the deepest band to
the root, one round per band; at the end each of them is added to its ancestors in the band
above, once more at most ``height``. The height is the square root of the longest
conversation, or ``HEIGHT`` if that is more, so rounds and explosion are bounded by it alike.

A node of which a third of all conversations are members, or children, is no special case:
counts, sums and smallest ids are aggregated before they are shuffled, and the one join on
parents is one that adaptive execution splits. The ids of those that end in a node are hashed
in order without gathering them: range partitions split a node's ids over tasks, which join
them to pieces, and the pieces of a node then pass one after another through a running hash.

Defined cases: turns are ordered by turn, null first; equal turns by hashes of role and text.
A null role or text is empty. A row with a null conversation id belongs to no conversation
and is left out. Repeated rows are turns like any other. Texts of any length are hashed whole.
An empty table has no conversations and so no node, not even a root. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import map_arrow, remainder, stored

# The least height of a band.
HEIGHT = 16
# Every conversation borrows from the one at the start of its block of so many ids, and fewer
# turns than ``MOST_BORROWED`` + 1.
BLOCK, MOST_BORROWED = 5, 8

NODE = ["depth", "hi", "lo"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, hi, lo, n_bytes``: every turn with its place from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "hi", "lo")
    return (
        conversations.where("conv_id is not null")
        .select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            "turn",
            F.xxhash64(F.lit(1), role, text).alias("hi"),
            F.xxhash64(text, F.octet_length(role), role).alias("lo"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
        )
        .withColumn("place", F.row_number().over(order))
        .drop("turn")
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations, in the order of ``part, place``.

    A conversation starts with the first turns of the one at the start of its block, as many
    as its own id says, and goes on with its own turns after as many. Every conversation also
    has a row for the root, part 0, even if no turn is left.
    """
    taken = remainder(F.col("conv_id"), 9)
    ids = turns.where("place = 1").select("conv_id")
    turn = F.struct("place", "hi", "lo", "n_bytes")
    heads = (
        turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") <= MOST_BORROWED))
        .groupBy(F.col("conv_id").alias("start"))
        .agg(F.sort_array(F.collect_list(turn)).alias("head"))
    )
    start = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("start")
    borrowed = (
        ids.select("conv_id", start, taken.cast("int").alias("taken"))
        .join(heads, "start")
        .select("conv_id", F.inline(F.slice("head", 1, F.col("taken"))))
    )
    root = ids.select("conv_id", *[F.lit(0).alias(c) for c in ("part", "place", "hi", "lo", "n_bytes")])
    own = turns.where(F.col("place") > taken)
    return root.unionByName(borrowed.withColumn("part", F.lit(1))).unionByName(
        own.withColumn("part", F.lit(2))
    )


def prefixes(rows: DataFrame, height: int) -> DataFrame:
    """Every prefix of every conversation: its node, and the nodes above it.

    ``path_hi, path_lo`` lead from the top of the node's band to the node. ``above_hi,
    above_lo`` are the path of the parent, for a node at the top of its band. ``ends`` says
    that the conversation has no further turn.
    """
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    recent = order.rowsBetween(-height, 0)
    depth = F.col("depth")
    salted = {
        "hi": F.when(depth > 0, F.xxhash64("depth", "hi", "lo")).otherwise(0),
        "lo": F.when(depth > 0, F.xxhash64("lo", F.lit(7), "hi", "depth")).otherwise(0),
    }
    places = (
        rows.withColumn("depth", F.row_number().over(order) - 1)
        .withColumns(salted)
        .withColumns({c: F.bit_xor(c).over(upto) for c in salted})
        .withColumns({f"all_{c}": F.collect_list(c).over(recent) for c in salted})
        .withColumn("ends", F.lead("depth").over(order).isNull())
    )
    in_band = depth % height + 1
    at_top = (depth > 0) & (depth % height == 0)
    paths = {}
    for c in salted:
        nodes = F.col(f"all_{c}")
        paths[f"path_{c}"] = F.slice(nodes, F.size(nodes) - in_band + 1, in_band)
        paths[f"above_{c}"] = F.when(at_top, F.slice(nodes, 1, height))
    return places.withColumns(paths).select("conv_id", *NODE, *paths, "n_bytes", "ends")


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _spread(df: DataFrame, hi: str, lo: str, first: Column) -> DataFrame:
    """The totals of each row at every node of a path that starts at depth ``first``."""
    nodes = F.posexplode(F.arrays_zip(F.col(hi).alias("hi"), F.col(lo).alias("lo")))
    spread = df.select(first.alias("first"), "leaves", "saved", nodes.alias("at", "node"))
    return spread.select(
        (F.col("first") + F.col("at")).alias("depth"),
        F.col("node.hi").alias("hi"),
        F.col("node.lo").alias("lo"),
        "leaves",
        "saved",
    )


def subtree_totals(nodes: DataFrame, height: int, deepest: int) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over every node's subtree, itself included."""
    top = F.col("depth") - F.col("depth") % height
    inside = _spread(nodes, "path_hi", "path_lo", top)
    if deepest < height:
        return _sums(inside)
    banded = stored(_sums(inside), "trie-bands")
    tops = (
        nodes.where((F.col("depth") > 0) & (F.col("depth") % height == 0))
        .select(*NODE, "above_hi", "above_lo")
        .join(banded, NODE)
    )
    tops = stored(tops, "trie-tops")
    finished = []
    for depth in range(deepest - deepest % height, 0, -height):
        here = tops.where(F.col("depth") == depth)
        if finished:
            below = finished[-1].groupBy(
                F.element_at("above_hi", 1).alias("hi"), F.element_at("above_lo", 1).alias("lo")
            )
            below = below.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            more = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
            here = here.join(below, ["hi", "lo"], "left").withColumns(more).select(*tops.columns)
            here = stored(here, "trie-round")
        finished.append(here)
    parts = [banded]
    for here in finished:
        parts.append(_spread(here, "above_hi", "above_lo", F.col("depth") - height))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _sums(every)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Nodes of a sorted batch with the rows each of them has there."""
    keys = [batch.column(i).to_numpy() for i in range(3)]
    changed = np.zeros(batch.num_rows, bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(changed)
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield tuple(int(k[start]) for k in keys), start, end


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``NODE, first, ids``: runs of one node's ids joined by commas."""
    for batch in batches:
        ids = batch.column(3).to_numpy()
        found = [
            (*node, int(ids[start]), ",".join(map(str, ids[start:end].tolist())))
            for node, start, end in _runs(batch)
        ]
        if found:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``NODE, ends_sha256`` from the pieces of each node in order."""

    def result(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
        return pa.RecordBatch.from_arrays(columns, [*NODE, "ends_sha256"])

    last, running = None, None
    for batch in batches:
        done, pieces = [], batch.column(4)
        for node, start, end in _runs(batch):
            if node != last:
                if last:
                    done.append((*last, running.hexdigest()))
                last, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(",".join(pieces.slice(start, end - start).to_pylist()).encode())
        if done:
            yield result(done)
    if last:
        yield result([(*last, running.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids that end there, in order, joined by commas."""
    key = "depth int, hi bigint, lo bigint"
    ends = ends.select(*NODE, "conv_id")
    by_id = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = map_arrow(by_id, _pieces, f"{key}, first bigint, ids string")
    by_node = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return map_arrow(by_node, _digests, f"{key}, ends_sha256 string")


def trie(conversations: DataFrame, height: int | None = None) -> DataFrame:
    """One row per node of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    if height is None:
        counts = conversations.groupBy("conv_id").count().where("conv_id is not null")
        longest = counts.agg(F.max("count")).first()[0] or 0
        height = max(HEIGHT, math.isqrt(longest + MOST_BORROWED))
    every = stored(prefixes(rebuilt(turns_of(conversations)), height), "trie-prefixes")
    paths = ["path_hi", "path_lo", "above_hi", "above_lo"]
    nodes = every.groupBy(*NODE, *paths).agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.max("n_bytes").alias("n_bytes"),
    )
    up = {
        c: F.when(F.size(f"path_{c}") > 1, F.try_element_at(f"path_{c}", F.lit(-2))).otherwise(
            F.try_element_at(f"above_{c}", F.lit(-1))
        )
        for c in ("hi", "lo")
    }
    nodes = stored(nodes.withColumns({f"up_{c}": v for c, v in up.items()}), "trie-nodes")
    children = (
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    counted = nodes.join(children, NODE, "left").withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)),
            "leaves": F.col("n_children").isNull().cast("bigint"),
            "saved": (F.col("n_convs") - 1) * F.col("n_bytes"),
        }
    )
    counted = stored(counted, "trie-counted")
    deepest = counted.agg(F.max("depth")).first()[0] or 0
    totals = subtree_totals(counted, height, deepest)
    ends = ends_digests(every.where("ends"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("hi").alias("up_hi"),
        F.col("lo").alias("up_lo"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        counted.drop("leaves", "saved", *paths)
        .join(totals, NODE)
        .join(ends, NODE, "left")
        .join(parents, ["depth", "up_hi", "up_lo"], "left")
        .select(
            "conv_id",
            F.col("depth").cast("bigint").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )

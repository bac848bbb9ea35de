"""Near duplicates by SimHash, compared in bit slices.

The fingerprint of a text takes the majority of each bit over the XXH64 of its word shingles.
Fingerprints that differ in at most ``radius`` bits agree on one of ``radius + 1`` parts of
their bits, so buckets by part hold every link. Within a bucket the fingerprints are stored
as bit planes: plane k has bit k of every member. One fingerprint meets all members at once;
each plane is added to carry-save counters, and the bucket is abandoned for it as soon as
every counter has passed the radius.

A bucket over ``BUCKET`` members is split again by the bits its members do not share, which
loses no link for the same reason. Members are distinct, so the last level is bounded by the
bits that are left. A bucket yields a forest of links, not its pairs.

Defined cases: a null text counts as empty. Texts without words have fingerprint zero and
link like any other. A text with fewer words than a shingle is one shingle. Repeated rows
and null ids keep their rows; ids that are null are never a representative unless a whole
component has none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import every, map_arrow, map_pandas, quoted, stored
from tarmac.llm.components import component_roots

BITS = 64
SEED = 42
BUCKET = 1024
LEVELS = 4
BYTE_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a UTF-8 text, unsigned. ``bytes`` lower and split by ASCII rules only."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    size = min(shingle, len(found))
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *(ends[: len(found) - size]).tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = [np.bincount(lanes[:, k], minlength=256) @ BYTE_BITS for k in range(8)]
    majority = np.concatenate(counts) * 2 > len(hashes)
    return int.from_bytes(np.packbits(majority, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long. Needs a ``text`` column."""
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in ("text", "fp")]
    rest = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            names = [*batch.schema.names[:-1], "fp"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=names)

    return map_arrow(docs.select(*kept, "text"), run, rest.add("fp", "long"))


def within(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a bucket: a forest that connects all members within ``radius`` bits.

    Counters are bit-sliced: ``sums[i]`` has bit i of every member's distance so far. A
    member whose distance has passed the radius leaves ``near`` and is not counted on.
    """
    planes = [0] * BITS
    for place, value in enumerate(values):
        bit = 1 << place
        while value:
            low = value & -value
            planes[low.bit_length() - 1] |= bit
            value ^= low
    # Planes on which the bucket agrees add nothing to any distance.
    everyone = (1 << len(values)) - 1
    used = [k for k in range(BITS) if planes[k] and planes[k] != everyone]
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    width = (radius + 1).bit_length()
    for place, value in enumerate(values):
        near = everyone >> (place + 1) << (place + 1)
        sums = [0] * width
        for k in used:
            if not near:
                break
            carry = (planes[k] ^ (everyone if value >> k & 1 else 0)) & near
            for i in range(width):
                sums[i], carry = sums[i] ^ carry, sums[i] & carry
            near &= ~(_reached(sums, radius + 1) | carry)
        while near:
            low = near & -near
            near ^= low
            other = low.bit_length() - 1
            a, b = root(place), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((values[place], values[other]))
    return links


def _reached(sums: list[int], limit: int) -> int:
    """Members whose sliced counter equals ``limit``; counters step by one, so none skips it."""
    hit = -1
    for i, s in enumerate(sums):
        hit &= s if limit >> i & 1 else ~s
    return hit


def _parts(mask: int, pieces: int) -> list[int]:
    """``mask`` with one of ``pieces`` equal parts of its unset bits set, for each part."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    cuts = [len(free) * i // pieces for i in range(pieces + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """Links of the buckets in ``rows`` (``mask, value, fp``), every bucket in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members = None, []
        for frame in frames:
            found = []
            for mask, value, fp in zip(
                frame["mask"].tolist(), frame["value"].tolist(), frame["fp"].tolist()
            ):
                if (mask, value) != key:
                    found += within(members, radius)
                    key, members = (mask, value), []
                members.append(fp & (1 << BITS) - 1)
            yield _frame(found)
        yield _frame(within(members, radius))

    dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return map_pandas(dealt, run, "a long, b long")


def _frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def near_links(prints: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links between the distinct fingerprints in ``prints.fp``, stored.

    They connect exactly the fingerprints within ``radius`` bits, directly or by others.
    """
    rows = prints.select("fp").distinct().withColumn("mask", F.lit(0).cast("bigint"))
    masks, links = [0], []
    for level in range(LEVELS):
        children = {m: _parts(m, radius + 1) for m in masks}
        options = F.create_map(
            *[
                x
                for m, parts in children.items()
                for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts]))
            ]
        )
        keyed = rows.select("fp", F.explode(options[F.col("mask")]).alias("mask")).withColumn(
            "value", F.col("fp").bitwiseAND(F.col("mask"))
        )
        sizes = stored(keyed.groupBy("mask", "value").count().where("count > 1"), "buckets")
        crowded = stored(keyed.join(sizes, ["mask", "value"]), "members")
        last = level == LEVELS - 1
        cold = crowded if last else crowded.where(F.col("count") <= bucket)
        links.append(stored(_compare(cold.select("mask", "value", "fp"), radius), "links"))
        rows = crowded.where(F.col("count") > bucket).select("fp", "mask")
        masks = [p for parts in children.values() for p in parts]
        if last or rows.isEmpty():
            break
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return every


def with_components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints`` (``doc_id, fp``) with ``component_id``, the smallest id that is reachable.

    ``root``, the smallest fingerprint of the component, names it also where all ids are null.
    """
    roots = component_roots(near_links(prints, radius))
    owners = prints.groupBy("fp").agg(F.min("doc_id").alias("owner"))
    placed = stored(
        owners.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "owner"
        ),
        "placed",
    )
    smallest = placed.groupBy("root").agg(F.min("owner").alias("component_id"))
    classes = placed.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp")


def simhash_digest(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: its fingerprint in hex digits and its component."""
    prints = stored(fingerprints(docs.select("doc_id", "text"), shingle), "prints")
    return with_components(prints, radius).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def row_key(docs: DataFrame) -> Column:
    """Content address of a row; equal rows are interchangeable."""
    values = [F.coalesce(c.cast("string"), F.lit("\0")) for c in every(docs)]
    return F.sha2(F.concat_ws("\x01", *values).cast("binary"), 256)


def one_per_component(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The row with the smallest id of every component; one of them if it repeats.

    Rows of equal ids are told apart by their content.
    """
    keyed = docs.select("doc_id", "text", row_key(docs).alias("key"))
    prints = stored(fingerprints(keyed, shingle), "prints")
    kept = (
        with_components(prints, radius)
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
        .select(F.col("best.key").alias("key"))
    )
    rows = docs.select(F.struct(*every(docs)).alias("row"), row_key(docs).alias("key"))
    once = rows.join(kept, "key", "left_semi").dropDuplicates(["key"])
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

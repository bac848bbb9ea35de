"""Which parts of two results differ, found before any row is shuffled.

The rows of both sides are divided by the leading bits of their keys' hash. Of each part a
side sends its row count and sums of its row hashes, which do not depend on the order of the
rows. Parts with equal sums hold the same rows equally often; only the others are compared row
by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first level has 2^16 parts. While at most 2^8 parts differ and hold many rows, each of
# them is divided by 8 more bits, so a level never has more than 2^16 counters.
FIRST_BITS, MORE_BITS, LAST_BITS = 16, 8, 40
MANY_ROWS = 1_000_000
# Row hashes are added in pieces of so many bits; a sum holds 2^39 rows, beyond that Spark stops.
PIECES = (24, 20, 20)


@dataclass(frozen=True)
class Narrowed:
    """The rows of both sides that lie in differing parts, and how many others there are."""

    a: DataFrame
    b: DataFrame
    parts: int
    equal_rows: int


def _part(key_hash: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - bits)


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def _pieces(columns: Sequence[str]) -> list[Column]:
    cells = [F.col(f"`{c}`") for c in columns]
    # Hashes pass over NULL, so its places are hashed too.
    whole = F.xxhash64(F.lit("row"), *cells, *[c.isNull() for c in cells])
    pieces, low = [], 0
    for bits in PIECES:
        pieces.append(F.shiftrightunsigned(whole, low).bitwiseAND((1 << bits) - 1))
        low += bits
    return pieces


def narrowed(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Narrowed:
    """Both sides without the parts that hold the same rows equally often.

    All rows of a key are in one part. The sides are read once per level, usually once or
    twice, and once more for what is left of them: compare stored results. If more than half
    of the parts differ, both sides are returned whole.
    """
    sides = [df.withColumn("_side", F.lit(s)) for s, df in enumerate((a, b))]
    stacked = sides[0].unionByName(sides[1])
    sums = [f"_sum{i}" for i in range(len(PIECES))]
    hashed = stacked.select(
        "_side",
        _key_hash(keys).alias("_key"),
        *[p.alias(name) for p, name in zip(_pieces(a.columns), sums)],
    )
    sign = F.when(F.col("_side") == 0, 1).otherwise(-1)
    bits, parts, equal = FIRST_BITS, None, 0
    while True:
        open_rows = hashed
        if parts is not None:
            open_rows = hashed.where(_part(F.col("_key"), bits - MORE_BITS).isin(parts))
        gaps = [F.sum(sign.cast("bigint") * F.col(s)) != 0 for s in sums]
        counters = (
            open_rows.groupBy(_part(F.col("_key"), bits).alias("part"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(sign).alias("more"),
                F.array_contains(F.array(*gaps), True).alias("gap"),
            )
            .collect()
        )
        differing = [r for r in counters if r.more != 0 or r.gap]
        left = sum(r.n for r in differing)
        equal += sum(r.n for r in counters) - left
        parts = [r.part for r in differing]
        if not parts or left <= MANY_ROWS or len(parts) > 1 << MORE_BITS or bits >= LAST_BITS:
            break
        bits += MORE_BITS
    if bits == FIRST_BITS and len(parts) > 1 << (FIRST_BITS - 1):
        return Narrowed(a, b, len(parts), 0)
    kept = [_rows_in(df, keys, bits, parts) for df in (a, b)]
    return Narrowed(*kept, len(parts), equal)


def _rows_in(df: DataFrame, keys: Sequence[str], bits: int, parts: list[int]) -> DataFrame:
    part = _part(_key_hash(keys), bits)
    if len(parts) <= 1 << MORE_BITS:
        return df.where(part.isin(parts)) if parts else df.where(F.lit(False))
    # At most 2^16 numbers.
    wanted = df.sparkSession.createDataFrame([(p,) for p in parts], "_part bigint")
    return df.withColumn("_part", part).join(F.broadcast(wanted), "_part", "left_semi").drop("_part")

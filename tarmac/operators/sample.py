"""Exact-size reproducible samples.

A row belongs to the sample when its seeded md5 is among the k smallest. The k-th
smallest hash is found by counting hash prefixes, never by sorting the data, and the
sample itself is then a plain filter against that hash: no shuffle, the same rows on every
run and after every lost executor, and every smaller sample is contained in the larger.

Rows that tie on the hash of their key are told apart by a second hash over all columns;
what still ties then are identical rows, and those are taken by count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.rowhash import HASH_DIGITS, row_hash
from tarmac.schema import SAMPLE_SEED, SCALES
from tarmac.session import stored

# Digits read per counting level: one level yields at most 16^4 = 65,536 counters.
STEP = 4
# A hash range with fewer rows than this is resolved hash by hash. The third level always is:
# it sees one prefix of 8 digits per size, a 2^32nd of the distinct hashes.
SMALL_RANGE = 1_000_000
# Identical rows are multiplied in blocks of this size, spread over the cluster.
COPY_BLOCK = 100_000


@dataclass(frozen=True)
class Cut:
    """Where a sample ends: after ``take`` of the ``tied`` rows whose hash is ``hash``."""

    hash: str
    take: int
    tied: int

    @property
    def splits_tie(self) -> bool:
        return self.take < self.tied

    def covers(self, h: Column) -> Column:
        return h < self.hash if self.splits_tie else h <= self.hash


EMPTY = Cut("", 0, 0)


def find_cuts(
    df: DataFrame,
    sizes: Sequence[float | int],
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
) -> list[Cut]:
    """The end of the sample for every size: a fraction (float) or a row count (int).

    Runs two or three counting jobs that read only the key columns and return one row
    per size.
    """
    hashed = df.select(row_hash(key or df.columns, seed).alias("h"))
    found = {i: EMPTY for i in range(len(sizes))}

    # First level: position of every size among the hash prefixes.
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counters = (
        hashed.groupBy(F.substring("h", 1, STEP).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(everything))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
    )
    goals = F.array(
        *[
            F.struct(F.lit(i).alias("i"), _rows_wanted(size, F.col("total")).alias("k"))
            for i, size in enumerate(sizes)
        ]
    )
    open_ranges = (
        counters.select("part", "n", "upto", F.inline(goals))
        .where((F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto")))
        .select("i", "part", "n", (F.col("k") - F.col("upto") + F.col("n")).alias("k"))
        .collect()
    )

    # Further levels: the same inside the one range each size ends in.
    digits = STEP
    while open_ranges:
        largest = max(r.n for r in open_ranges)
        deeper = HASH_DIGITS if largest <= SMALL_RANGE or digits > STEP else digits + STEP
        open_ranges = _narrow(hashed, open_ranges, digits, deeper)
        digits = deeper
        if digits == HASH_DIGITS:
            found.update({r.i: Cut(r.part, r.k, r.n) for r in open_ranges})
            break
    return [found[i] for i in range(len(sizes))]


def _rows_wanted(size: float | int, total: Column) -> Column:
    if isinstance(size, int):
        return F.lit(size).cast("bigint")
    return F.bround(F.lit(float(size)) * total).cast("bigint")


def _narrow(hashed: DataFrame, ranges: list, digits: int, deeper: int) -> list:
    """Sub-range of every open range that holds the wanted position."""
    parents = sorted({r.part for r in ranges})
    within = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    goals = F.array(
        *[
            F.struct(
                F.lit(r.i).alias("i"),
                F.lit(r.part).alias("inside"),
                F.lit(r.k).cast("bigint").alias("k"),
            )
            for r in ranges
        ]
    )
    return (
        hashed.where(F.substring("h", 1, digits).isin(parents))
        .groupBy(
            F.substring("h", 1, digits).alias("parent"), F.substring("h", 1, deeper).alias("part")
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(within))
        .select("parent", "part", "n", "upto", F.inline(goals))
        .where(F.col("parent") == F.col("inside"))
        .where((F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto")))
        .select("i", "part", "n", (F.col("k") - F.col("upto") + F.col("n")).alias("k"))
        .collect()
    )


def exact_sample(
    df: DataFrame,
    fraction: float,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    strata: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly ``round(fraction * rows)`` rows without replacement.

    ``key`` names columns that identify a row; without it all columns are hashed. With
    ``strata`` the fraction is taken of every stratum separately.

    The end of the sample is counted in two or three passes over the hashed columns before
    the sample itself is read. Sample stored data, or name a narrow key, so that an expensive
    input is not computed for each of them.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    if fraction == 1:
        return df
    if strata:
        return _sample_strata(df, float(fraction), key, seed, list(strata))
    cut = find_cuts(df, [float(fraction)], key, seed)[0]
    return _rows_of(df, cut, key, seed)


def shuffled(df: DataFrame, key: Sequence[str] | None = None, seed: int = SAMPLE_SEED) -> DataFrame:
    """All rows in a reproducible random order: by the hash of their key, then of the row.

    What still ties are identical rows, so the order is total. Rows of one key are split among
    the tasks of the sort by their own hash. Identical rows that would fill half a task are
    counted and numbered, and split by number; they are found by counting hash prefixes.
    """
    of_row = row_hash(df.columns, seed)
    # Columns of bytes before the sort, which would hash both rows anew in each comparison; their
    # order is that of the digits.
    hashes = {_free_name(df, "_row"): F.unhex(of_row)}
    if key:
        hashes = {_free_name(df, "_key"): F.unhex(row_hash(key, seed))} | hashes
    copy = _free_name(df, "_copy")
    heavy = _heavy_hashes(df.select(of_row.alias("h")))
    others = df.where(~of_row.isin(heavy)) if heavy else df
    rows = others.withColumns(hashes).withColumn(copy, F.lit(0).cast("bigint"))
    if heavy:
        columns = [F.col(f"`{c}`") for c in df.columns]
        counted = df.where(of_row.isin(heavy)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.unionByName(_repeat(counted.withColumns(hashes), copy))
    return rows.orderBy(*hashes, copy).drop(*hashes, copy)


def _free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _heavy_hashes(hashed: DataFrame) -> list[str]:
    """Hashes ``h`` of so many rows that they would fill half a task; there are at most two
    per task."""
    prefix = F.substring("h", 1, STEP)
    counters = hashed.groupBy(prefix.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in counters)
    tasks = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(COPY_BLOCK, total // (2 * tasks), 2 * total // 16**STEP)
    parts = [r.part for r in counters if r.n > least]
    if not parts:
        return []
    each = hashed.where(prefix.isin(parts)).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.h for r in each.where(F.col("n") > least).collect())


def numbered(df: DataFrame, column: str = "place") -> DataFrame:
    """The rows of a sorted ``df``, stored, with their places from 0 in ``column``.

    Every task numbers its own rows; a task's first place is the count of rows before it. A
    column of that name is replaced.
    """
    spark, at = df.sparkSession, _free_name(df, "_at")
    # The upper bits of this id are the task, the lower 33 the row's place in it.
    rows = stored(df.withColumn(at, F.monotonically_increasing_id()), "order")
    task = F.shiftright(at, 33).alias("task")
    starts, total = [], 0
    for r in sorted(rows.groupBy(task).agg(F.count("*").alias("n")).collect()):
        starts.append((r.task, total))
        total += r.n
    first = spark.createDataFrame(starts, "task bigint, first bigint").alias("s")
    place = F.col("s.first") + F.col(at).bitwiseAND(2**33 - 1)
    kept = [F.col(f"r.`{c}`") for c in df.columns if c != column]
    joined = rows.alias("r").join(F.broadcast(first), F.shiftright(F.col(f"r.{at}"), 33) == F.col("s.task"))
    return joined.select(*kept, place.alias(column))


def oversample(
    df: DataFrame, extra: float = 0.5, key: Sequence[str] | None = None, seed: int = SAMPLE_SEED
) -> DataFrame:
    """All rows plus ``extra`` times as many: whole copies, and an exact sample for the rest.

    With 0.5 a row appears once or twice, with 1.5 twice or three times.
    """
    if extra < 0:
        raise ValueError("extra is not negative")
    times, rest = 1 + int(extra), float(extra) % 1
    cut = find_cuts(df, [rest], key, seed)[0] if rest else EMPTY
    more = cut.covers(row_hash(key or df.columns, seed)) if rest else F.lit(False)
    copies = F.when(more, F.lit(times + 1)).otherwise(F.lit(times))
    repeated = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    return repeated.unionByName(_split_tie(df, cut, key, seed)) if cut.splits_tie else repeated


def percent_labels(scales: Sequence[float]) -> list[int]:
    """The scales in percent. Two scales must not share a label, and labels are whole."""
    labels = [round(s * 100) for s in scales]
    odd = [s for s, label in zip(scales, labels) if s <= 0 or abs(s * 100 - label) > 1e-6]
    if odd or len(set(labels)) < len(labels):
        raise ValueError(f"scales are different whole percentages, not {list(scales)}")
    return labels


def scaled(
    df: DataFrame,
    scales: Sequence[float] = SCALES,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
) -> DataFrame:
    """Every scaled dataset in one frame, told apart by the ``scale`` column in percent.

    The input is scanned once for all scales: a row is repeated for each scale it is in.
    """
    h = row_hash(key or df.columns, seed)
    percents = percent_labels(scales)
    partial = sorted({p % 100 for p in percents if p % 100})
    sizes = [p / 100 for p in partial]
    cuts = dict(zip(partial, find_cuts(df, sizes, key, seed) if partial else []))
    members, ties = [], []
    for percent in percents:
        label = F.lit(percent)
        members += [label] * (percent // 100)
        if percent % 100:
            cut = cuts[percent % 100]
            members.append(F.when(cut.covers(h), label))
            if cut.splits_tie:
                ties.append(_split_tie(df, cut, key, seed).withColumn("scale", label))
    spread = df.withColumn("scale", F.explode(F.array_compact(F.array(*members))))
    return reduce(DataFrame.unionByName, ties, spread)


# Band of rows that lie in whole copies only.
WHOLE = 100


def banded(
    df: DataFrame,
    scales: Sequence[float] = SCALES,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    column: str = "band",
) -> DataFrame:
    """All rows once, with the smallest partial percentage of ``scales`` that holds them.

    Samples are nested, so a row of band 25 is in every sample of 25 percent or more; rows in
    none are in band ``WHOLE``. Where a sample ends among rows of one hash, those it takes come
    once more, in the negative band of that percentage alone.
    """
    h = row_hash(key or df.columns, seed)
    partial = sorted({p % 100 for p in percent_labels(scales) if p % 100})
    cuts = find_cuts(df, [p / 100 for p in partial], key, seed) if partial else []
    inside = [F.when(cut.covers(h), p) for p, cut in zip(partial, cuts)]
    rows = df.withColumn(column, F.coalesce(*inside, F.lit(WHOLE)))
    ties = [
        _split_tie(df, cut, key, seed).withColumn(column, F.lit(-p))
        for p, cut in zip(partial, cuts)
        if cut.splits_tie
    ]
    return reduce(DataFrame.unionByName, ties, rows)


def copies_in(scales: Sequence[float], band: Column) -> Column:
    """The scales in percent that hold rows of ``band``, with how often they hold them."""
    entries = []
    for percent in percent_labels(scales):
        whole, part = divmod(percent, 100)
        more = band.between(1, part) | (band == -part) if part else F.lit(False)
        times = F.when(band > 0, whole).otherwise(0) + F.when(more, 1).otherwise(0)
        entry = F.struct(F.lit(percent).alias("scale"), times.alias("copies"))
        entries.append(F.when(times > 0, entry))
    return F.array_compact(F.array(*entries))


def _rows_of(df: DataFrame, cut: Cut, key: Sequence[str] | None, seed: int) -> DataFrame:
    rows = df.where(cut.covers(row_hash(key or df.columns, seed)))
    return rows.unionByName(_split_tie(df, cut, key, seed)) if cut.splits_tie else rows


def _split_tie(df: DataFrame, cut: Cut, key: Sequence[str] | None, seed: int) -> DataFrame:
    """``cut.take`` of the rows whose hash equals the cut."""
    tied = df.where(row_hash(key or df.columns, seed) == cut.hash)
    if key and set(key) != set(df.columns):
        # Different rows under one key: the hash of the whole row decides.
        return _rows_of(tied, find_cuts(tied, [cut.take], None, seed)[0], None, seed)
    # Identical rows: counting them is enough, whichever of them are meant.
    groups = tied.groupBy(*tied.columns).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*tied.columns).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(cut.take) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    return _repeat(groups.withColumn("_n", F.greatest(F.lit(0), F.least(F.col("_n"), left))))


def _repeat(groups: DataFrame, number: str | None = None) -> DataFrame:
    """Each row ``_n`` times, the copies of one row spread over many tasks.

    Blocks of copies are dealt round robin to a stated number of tasks; without that number
    adaptive execution would merge the blocks, which are small before they are multiplied.
    With ``number``, a column of that name counts the copies of a row from 0.
    """
    blocks = groups.where("_n > 0").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPY_BLOCK)))
    )
    size = F.least(F.lit(COPY_BLOCK), F.col("_n") - F.col("_block") * COPY_BLOCK)
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = (
        blocks.withColumn("_size", size.cast("int"))
        .repartition(tasks)
        .select("*", F.posexplode(F.array_repeat(F.lit(1), F.col("_size"))).alias("_at", "_one"))
    )
    if number:
        copies = copies.withColumn(number, F.col("_block") * COPY_BLOCK + F.col("_at"))
    return copies.drop("_n", "_block", "_size", "_at", "_one")


def _sample_strata(
    df: DataFrame, fraction: float, key: Sequence[str] | None, seed: int, strata: list[str]
) -> DataFrame:
    """Per-stratum sample by a table of cuts, one row per stratum.

    Every counting level scans the hashed columns once and stores its table; with a key
    whose hashes tie at a cut, three more levels tell the tied rows apart by the hash of the
    whole row. The sample is one more scan that meets the stored cuts. Spark broadcasts them
    while they are below its threshold; beyond it there are so many strata that the rows
    spread over them, and a stratum with most of the rows meets a single cut, so adaptive
    execution can split it. Only identical rows that tie at a cut are scanned once more.
    """
    names = [f"_s{i}" for i in range(len(strata))]
    of_key = row_hash(key, seed) if key else None
    of_row = row_hash(df.columns, seed)
    places = [F.col(s).alias(n) for s, n in zip(strata, names)]
    hashed = df.select(*places, (of_key if key else of_row).alias("h"))
    ends = _strata_cuts(hashed, names, STEP, _rows_wanted(fraction, F.col("total")), None)
    h = of_key if key else of_row
    if key and not ends.where("k < n").isEmpty():
        h = F.concat(of_key, of_row)
        hashed = df.select(*places, h.alias("h"))
        ends = _strata_cuts(hashed, names, HASH_DIGITS + STEP, None, ends)

    cuts = ends.select(
        *names, F.col("part").alias("_cut"), F.col("k").alias("_take"), F.col("n").alias("_tied")
    )
    on = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(n)) for s, n in zip(strata, names)])
    joined = df.withColumn("_h", h).join(cuts, on)
    split = F.col("_take") < F.col("_tied")
    # Where the cut splits a tie, the tied rows are not below it.
    inside = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & ~split)
    below = joined.where(inside).select(*df.columns)
    if cuts.where(split).isEmpty():
        return below
    tied = joined.where((F.col("_h") == F.col("_cut")) & split)
    before = (
        Window.partitionBy(*strata)
        .orderBy(*df.columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.col("_take") - F.coalesce(F.sum("_n").over(before), F.lit(0))
    groups = (
        tied.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_take").alias("_take"))
        .withColumn("_n", F.greatest(F.lit(0), F.least(F.col("_n"), left)))
        .drop("_take")
    )
    return below.unionByName(_repeat(groups))


def _strata_cuts(
    hashed: DataFrame,
    names: list[str],
    first: int,
    wanted: Column | None,
    ends: DataFrame | None,
) -> DataFrame:
    """Per stratum the hash where its sample ends, and ``k`` of ``n`` rows to take there.

    Three counting levels of ``first``, ``first + STEP`` and all digits of one hash. With
    ``ends``, the search goes on inside them.
    """
    position = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    whole = first - STEP + HASH_DIGITS
    done = first - STEP
    for deeper in (first, first + STEP, whole):
        part = F.substring("h", 1, deeper).alias("part")
        if ends is None:
            counters = hashed.groupBy(*names, part).agg(F.count(F.lit(1)).alias("n"))
            total = F.sum("n").over(Window.partitionBy(*names))
            counters = counters.withColumn("total", total).withColumn("k", wanted).drop("total")
        else:
            parents = ends.select(
                *[F.col(n).alias(f"{n}_p") for n in names],
                F.col("part").alias("parent"),
                "k",
            )
            same = reduce(
                lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_p")) for n in names]
            ) & (F.substring("h", 1, done) == F.col("parent"))
            counters = (
                hashed.join(parents, same)
                .groupBy(*names, part)
                .agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
            )
        upto = counters.withColumn("upto", F.sum("n").over(position))
        here = (F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto"))
        located = upto.where(here).select(
            *names, "part", "n", (F.col("k") - F.col("upto") + F.col("n")).alias("k")
        )
        ends, done = stored(located, "cuts"), deeper
    return ends

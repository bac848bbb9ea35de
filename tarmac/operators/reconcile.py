"""Comparing two versions of a result.

Both versions are stacked and grouped by key, so one shuffle pairs the rows. Grouping
treats NULL keys as equal and collapses repeated keys, where a join would lose the former
and multiply the latter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import nan_to_null
from tarmac.operators.checksums import narrowed
from tarmac.session import stored

TOLERANCE = 0.01


def _clean(df: DataFrame) -> DataFrame:
    """NaN cells count as missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`").cast("double")) for c in floats})


def _stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    lacking = [c for c in a.columns if c not in b.columns]
    if lacking or len(a.columns) != len(b.columns):
        raise ValueError(f"the two results have different columns: {a.columns} / {b.columns}")
    return (
        _clean(a)
        .withColumn("_side", F.lit(0))
        .unionByName(_clean(b).withColumn("_side", F.lit(1)))
    )


def pair_rows(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    names: tuple[str, str] = ("a", "b"),
    texts: bool = True,
) -> DataFrame:
    """One row per key: ``rows_<name>`` per side and every other column once per side.

    Where a key repeats within a side, its largest values stand for the group; the row
    counts show that it repeats, and ``same_<column>`` whether both sides hold the same
    values equally often. Without ``texts``, hashes stand for text columns, which lets the
    aggregation keep its groups in a hash table.
    """
    stacked = _stacked(a, b)
    values = [c for c in a.columns if c not in keys]
    kinds = {f.name: f.dataType for f in stacked.schema.fields}
    measures = []
    for side, name in enumerate(names):
        here = F.col("_side") == side
        measures.append(F.count_if(here).alias(f"rows_{name}"))
        for c in values:
            value = F.col(f"`{c}`")
            if isinstance(kinds[c], T.StringType) and not texts:
                value = F.when(value.isNotNull(), F.xxhash64(value))
            measures.append(F.max(F.when(here, value)).alias(f"{c}_{name}"))
    for c in values:
        # Sums of row hashes are equal if the sides hold the same values equally often.
        each = F.xxhash64(F.lit(c), F.col(f"`{c}`")).cast("decimal(20,0)")
        total = F.sum(F.when(F.col("_side") == 0, each).otherwise(-each))
        measures.append((total == 0).alias(f"same_{c}"))
    return stacked.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*measures)


def _differs(df: DataFrame, column: str, names: tuple[str, str], tolerance: float) -> Column:
    """Cells differ: NULL equals only NULL, numbers may be ``tolerance`` apart."""
    left, right = (F.col(f"`{column}_{n}`") for n in names)
    unequal = ~left.eqNullSafe(right)
    kinds = [df.schema[f"{column}_{n}"].dataType for n in names]
    if not all(isinstance(k, T.NumericType) for k in kinds):
        return unequal
    wide = T.DecimalType(30, 12)
    gap = F.abs(left.try_cast(wide) - right.try_cast(wide))
    return unequal & ~F.coalesce(gap <= F.lit(tolerance).cast(wide), F.lit(False))


def _value_columns(a: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in a.columns if c not in keys]


def reconcile(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    job: str = "",
    tolerance: float = TOLERANCE,
    names: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """One summary row: row counts, keys found on one side, differing cells, verdict."""
    pairs = pair_rows(a, b, keys, names, texts=False)
    values = _value_columns(a, keys)
    rows_a, rows_b = (F.col(f"rows_{n}") for n in names)
    matched = (rows_a == 1) & (rows_b == 1)
    differing = {c: matched & _differs(pairs, c, names, tolerance) for c in values}
    summary = pairs.agg(
        F.coalesce(F.sum(rows_a), F.lit(0)).alias(f"rows_{names[0]}"),
        F.coalesce(F.sum(rows_b), F.lit(0)).alias(f"rows_{names[1]}"),
        F.count_if(rows_b == 0).alias(f"only_{names[0]}"),
        F.count_if(rows_a == 0).alias(f"only_{names[1]}"),
        F.count_if((rows_a > 1) | (rows_b > 1)).alias("repeated_keys"),
        *[F.count_if(d).alias(f"diff_{c}") for c, d in differing.items()],
    )
    cells = reduce(lambda x, y: x + y, [F.col(f"`diff_{c}`") for c in values], F.lit(0))
    same_length = F.col(f"rows_{names[0]}") == F.col(f"rows_{names[1]}")
    unpaired = F.col(f"only_{names[0]}") + F.col(f"only_{names[1]}")
    verdict = (
        F.when(~same_length, "different row counts")
        .when(F.col("repeated_keys") > 0, "repeated keys")
        .when(unpaired > 0, "different keys")
        .when(F.col("diff_cells") > 0, "different cells")
        .otherwise("identical")
    )
    return (
        summary.withColumn("job", F.lit(job))
        .withColumn("same_length", same_length)
        .withColumn("diff_cells", cells.cast("bigint"))
        .withColumn("verdict", verdict)
        .select(
            "job",
            f"rows_{names[0]}",
            f"rows_{names[1]}",
            "same_length",
            f"only_{names[0]}",
            f"only_{names[1]}",
            "repeated_keys",
            "diff_cells",
            "verdict",
            *[F.col(f"`diff_{c}`") for c in values],
        )
    )


SUMMARY_COLUMNS = [
    "job",
    "rows_a",
    "rows_b",
    "same_length",
    "only_a",
    "only_b",
    "repeated_keys",
    "diff_cells",
    "verdict",
]


def missing_input(spark, job: str) -> DataFrame:
    """Summary row of a job one of whose results does not exist."""
    kinds = "string, bigint, bigint, boolean, bigint, bigint, bigint, bigint, string".split(", ")
    schema = ", ".join(f"{c} {k}" for c, k in zip(SUMMARY_COLUMNS, kinds))
    return spark.createDataFrame([(job, *[None] * 7, "missing input")], schema)


def differing_cells(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per differing cell: key, column and both values as text.

    A key that does not have exactly one row on either side gets an entry ``(row)`` with its
    row counts. If it has rows on both, every column whose values the sides do not hold
    equally often is listed with the largest of them.
    """
    names = ("a", "b")
    pairs = pair_rows(a, b, keys, names)
    single = (F.col("rows_a") == 1) & (F.col("rows_b") == 1)
    both = (F.col("rows_a") > 0) & (F.col("rows_b") > 0)

    def entry(name: str, left: Column, right: Column) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"),
            left.cast("string").alias("value_a"),
            right.cast("string").alias("value_b"),
        )

    cells = [
        F.when(
            F.when(single, _differs(pairs, c, names, tolerance)).otherwise(
                both & ~F.col(f"`same_{c}`")
            ),
            entry(c, F.col(f"`{c}_a`"), F.col(f"`{c}_b`")),
        )
        for c in _value_columns(a, keys)
    ]
    whole = F.when(~single, entry("(row)", F.col("rows_a"), F.col("rows_b")))
    return pairs.select(
        *[F.col(f"`{k}`") for k in keys], F.inline(F.array_compact(F.array(whole, *cells)))
    )


def occurrences(df: DataFrame, groups: Sequence[str], name: str = "occurrence") -> DataFrame:
    """Numbers the rows of every group from 1 in the order of their other columns.

    The rows are sorted by range, so a group with most of the rows lies in several tasks, and
    numbered inside each task; groups that reach over tasks then go on from the counts of the
    tasks before, of which a group has at most one each.
    """
    others = [c for c in df.columns if c not in groups]
    keys, values = ([F.col(f"`{c}`") for c in part] for part in (groups, others))
    ordered = df.repartitionByRange(*keys, *values).withColumn("_task", F.spark_partition_id())
    ordered = stored(ordered, "occurrences")
    inside = Window.partitionBy("_task", *keys).orderBy(*values)
    counts = ordered.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before is not null")
    named = {c: f"_group{i}" for i, c in enumerate(groups)}
    carried = carried.select(
        F.col("_task").alias("_of"), "_before", *[F.col(f"`{c}`").alias(n) for c, n in named.items()]
    )
    same = reduce(
        lambda x, y: x & y,
        [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in named.items()],
        F.col("_task") == F.col("_of"),
    )
    numbered = ordered.withColumn("_inside", F.row_number().over(inside)).join(carried, same, "left")
    place = F.col("_inside") + F.coalesce("_before", F.lit(0))
    return numbered.select(*keys, *values, place.alias(name))


def paired_cells(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    tolerance: float = TOLERANCE,
    checksums: bool = False,
) -> DataFrame:
    """The differing cells of rows with one key paired one by one.

    The rows of a key are numbered on each side in the order of their other columns, and the
    nth rows of both sides are compared. One row per differing cell: key, ``occurrence``,
    column and both values as text; a row without a partner gets an entry ``(row)``. With ``checksums`` only rows in parts of the
    keys that differ are shuffled; the result is the same.
    """
    both = _stacked(a, b)
    if checksums:
        less = narrowed(a, b, keys)
        both = _stacked(less.a, less.b)
    stacked = both.select(*[F.col(f"`{c}`") for c in a.columns], "_side")
    numbered = occurrences(stacked, [*keys, "_side"])
    sides = [numbered.where(F.col("_side") == side).drop("_side") for side in (0, 1)]
    return differing_cells(*sides, [*keys, "occurrence"], tolerance)


def side_by_side(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    n: int = 10,
    names: tuple[str, str] = ("locale", "cluster"),
) -> DataFrame:
    """The first ``n`` keys with every column of both results next to each other."""
    pairs = pair_rows(a, b, keys, names)
    values = _value_columns(a, keys)
    columns = [F.col(f"`{c}_{name}`") for name in names for c in values]
    present = [(F.col(f"rows_{name}") > 0).alias(f"in_{name}") for name in names]
    order = [F.asc_nulls_first(f"`{k}`") for k in keys]
    return pairs.orderBy(*order).limit(n).select(*[F.col(f"`{k}`") for k in keys], *present, *columns)


def set_difference(
    a: DataFrame, b: DataFrame, multiplicity: bool = False, checksums: bool = False
) -> DataFrame:
    """Rows found in one result only, both directions from one shuffle.

    Compares sets of distinct rows, or with ``multiplicity`` also how often a row occurs;
    ``rows_a`` and ``rows_b`` give the counts. With ``checksums`` only rows in parts that
    differ are shuffled; the result is the same.
    """
    columns = a.columns
    if checksums:
        less = narrowed(a, b, columns)
        a, b = less.a, less.b
    tagged = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_a", F.lit(0)))
    counted = tagged.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(
        F.sum("_a").alias("rows_a"), F.count_if(F.col("_a") == 0).alias("rows_b")
    )
    if multiplicity:
        return counted.where(F.col("rows_a") != F.col("rows_b"))
    return counted.where((F.col("rows_a") == 0) | (F.col("rows_b") == 0))

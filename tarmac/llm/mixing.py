"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget in proportion to its weight, but no more than
``max_epochs`` times its own size. What capped sources cannot take is dealt to the others by
weight until none is above its cap. A source then repeats whole as often as its target
allows, and documents in seeded order of id and text fill the fractional rest.

Defined cases: a null or empty text has size 0 and takes nothing. A null source is a source
of its own. Rows of one source with equal ids go by their texts. Where the rest ends among rows
of equal id and text, as many of them as it needs are taken; these are interchangeable, and which
they are may follow the layout of the files. Without any documents there are no targets. If every
source is capped, the budget is not reached. A very long text is one row of its task. Other columns
are never read, whatever their names; ``mixed`` replaces columns of the names it adds, whatever
their case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac.llm.common import quoted, stored, words

# The seeded order is a number of 60 bits, searched in four digits of 15 bits.
DIGITS, DIGIT_BITS = 4, 15


def order_key(docs: DataFrame, seed: int) -> Column:
    """Seeded place of a document by id and text, 0 to 2^60 - 1."""
    content = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    text = F.concat(F.lit(f"{seed}:"), content, F.lit(":"), key)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, place`` of every document, stored; size counts its words."""
    return stored(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.size(words(F.col("text"))).cast("bigint").alias("size"),
            order_key(docs, seed).alias("place"),
        ),
        "sized",
    )


def repeating_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``source, weight``: the weights dealt to the sources by code point, null last.

    Ranks come from ranges: each task numbers its own range and adds the rows of the ranges
    before it, so the sources never meet in one task.
    """
    by_name = F.col("source").asc_nulls_last()
    dealt = stored(
        sources.select("source")
        .distinct()
        .repartitionByRange(by_name)
        .withColumn("range", F.spark_partition_id()),
        "ranges",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("range")
        .count()
        .select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    number = F.row_number().over(Window.partitionBy("range").orderBy(by_name)) - 1
    rank = (F.col("start") + F.col("number")).cast("bigint")
    return (
        dealt.withColumn("number", number)
        .join(starts, "range")
        .select(
            "source",
            F.get(
                F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int")
            ).alias("weight"),
        )
    )


def water_fill(sources: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """``sources`` (``source, size, weight``) with ``target``.

    A round is one aggregation over the sources. The level only rises, so a source that is
    capped once stays so, and the rounds end when none is added.
    """
    cap = F.col("size") * max_epochs
    level, clamped = None, -1
    total = sources.agg(budget.alias("budget")).first()["budget"] or 0
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("used"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
            F.count_if(above).alias("clamped"),
        ).first()
        if row["clamped"] == clamped or row["weight"] is None:
            break
        clamped = row["clamped"]
        level = (float(total) - float(row["used"])) / float(row["weight"])
    share = F.lit(0.0) if level is None else F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.least(share, cap.cast("double")))


def fractional_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with whole repetitions and the last place ``cut`` that repeats once more.

    The words before the cut come as near to the rest as whole documents allow: the document
    in which the rest ends is in if its middle lies before that point. If equal rows share that
    place and only some are in, the cut lies before it and ``edge`` is their number. The cut is
    found digit by digit from sums per (source, digit); nothing is sorted but these sums.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    states = stored(
        targets.select(
            "source",
            F.col("size").alias("source_size"),
            "target",
            whole.cast("int").alias("whole"),
            (F.col("target") - whole * F.col("size")).alias("rest"),
            F.lit(0).cast("bigint").alias("prefix"),
            F.lit(0).cast("bigint").alias("before"),
            F.lit(0).cast("bigint").alias("inside"),
            F.lit(0).cast("bigint").alias("rows"),
        ),
        "targets",
    )
    rest = F.col("rest")
    for digit in range(DIGITS):
        shift = (DIGITS - 1 - digit) * DIGIT_BITS
        known = F.shiftright("place", shift + DIGIT_BITS) == F.col("prefix")
        counters = (
            _with_source(sized, states.where("rest > 0").select("source", "prefix"), known)
            .groupBy("source", F.shiftright("place", shift).alias("next"))
            .agg(F.sum("size").alias("inside"), F.count("*").alias("rows"))
        )
        upto = Window.partitionBy("source").orderBy("next")
        running = counters.withColumn("upto", F.sum("inside").over(upto))
        found = (
            _with_source(running, states.select("source", "rest", "before"), F.lit(True))
            .where(F.col("before") + F.col("upto") >= rest)
            .groupBy("source")
            .agg(F.min(F.struct("next", "inside", "upto", "rows")).alias("hit"))
        )
        states = stored(
            states.alias("s")
            .join(found.alias("f"), F.expr("s.source <=> f.source"), "left")
            .select(
                "s.source",
                "source_size",
                "target",
                "whole",
                "rest",
                F.coalesce("hit.next", F.shiftleft("prefix", DIGIT_BITS)).alias("prefix"),
                F.expr("before + coalesce(hit.upto - hit.inside, 0L)").alias("before"),
                F.expr("coalesce(hit.inside, 0L)").alias("inside"),
                F.expr("coalesce(hit.rows, 0L)").alias("rows"),
            ),
            "cuts",
        )
    needed = F.ceil((rest - F.col("before")) * F.col("rows") / F.col("inside") - 0.5)
    taken = F.when(F.col("inside") > 0, F.greatest(F.lit(0), F.least("rows", needed))).otherwise(0)
    all_in = taken == F.col("rows")
    return states.select(
        "source",
        "source_size",
        "target",
        "whole",
        F.when(rest <= 0, -1)
        .when(all_in, F.col("prefix"))
        .otherwise(F.col("prefix") - 1)
        .cast("bigint")
        .alias("cut"),
        F.when((rest <= 0) | all_in, 0).otherwise(taken).cast("bigint").alias("edge"),
    )


def _with_source(left: DataFrame, right: DataFrame, also: Column) -> DataFrame:
    """Rows of ``left`` with the row of their source in ``right``."""
    renamed = right.withColumnRenamed("source", "_source")
    return left.join(renamed, F.col("source").eqNullSafe(F.col("_source")) & also).drop("_source")


def plan_mix(
    sized: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget_percent: int = 150,
    max_epochs: int = 2,
) -> DataFrame:
    """Per source ``source, source_size, target, whole, cut, edge`` for ``measured`` documents."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("size"))
    dealt = repeating_weights(sizes, weights).withColumnRenamed("source", "_source")
    sources = stored(
        sizes.join(dealt, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"),
        "sources",
    )
    budget = F.sum("size") * budget_percent / F.lit(100.0)
    return stored(fractional_cuts(sized, water_fill(sources, budget, max_epochs)), "plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and ``copies``, the times each is taken."""
    planned = _with_source(rows, plan, F.lit(True))
    known = planned.withColumn("copies", F.col("whole") + (F.col("place") <= F.col("cut")).cast("int"))
    if plan.where("edge > 0").isEmpty():
        return known
    on_edge = (F.col("edge") > 0) & (F.col("place") == F.col("cut") + 1)
    return known.where(~on_edge).unionByName(_numbered_edge(planned.where(on_edge)))


def _numbered_edge(rows: DataFrame) -> DataFrame:
    """Rows at the place where their source's rest ends: the first ``edge`` repeat once more.

    Each task's rows are numbered on their own and go on from the counts of the tasks before, so
    a large group of equal rows never meets in one task.
    """
    kept = stored(
        rows.withColumn("task", F.spark_partition_id()).withColumn(
            "row_id", F.monotonically_increasing_id()
        ),
        "edge",
    )
    before = Window.partitionBy("source").orderBy("task")
    starts = (
        kept.groupBy("source", "task")
        .count()
        .select(
            F.col("source").alias("_source"),
            F.col("task").alias("_task"),
            (F.sum("count").over(before) - F.col("count")).alias("start"),
        )
    )
    number = F.row_number().over(Window.partitionBy("source", "task").orderBy("row_id"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("task") == F.col("_task"))
    chosen = (F.col("start") + F.col("number") <= F.col("edge")).cast("int")
    return (
        kept.withColumn("number", number)
        .join(starts, same)
        .withColumn("copies", F.col("whole") + chosen)
        .select(*rows.columns, "copies")
    )


def mixed(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, numbered by ``repetition``.

    Columns ``source_size``, ``target`` and ``repetition`` are added. ``options`` go to
    ``plan_mix``.
    """
    plan = plan_mix(measured(docs, seed), **options)
    rows = docs.select(
        F.struct(*[docs[quoted(c)].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
        F.col("source").cast("string").alias("source"),
        order_key(docs, seed).alias("place"),
    )
    taken = with_copies(rows, plan).where("copies > 0")
    added = ("source_size", "target", "repetition")
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in added]
    return taken.select(
        *[F.col("row").getField(field).alias(name) for field, name in kept],
        "source_size",
        "target",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("repetition"),
    )


def mix_digest(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken."""
    sized = measured(docs, seed)
    return with_copies(sized, plan_mix(sized)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )

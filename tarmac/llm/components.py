"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored


def component_roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``) except the roots.

    The root is the smallest node of the component. Large-star and small-star rounds replace
    links by links to the smallest neighbour until nothing changes; the rounds grow with the
    logarithm of the longest chain. Minima are combined before the shuffle, so a node with a
    third of all links is one partial row per task; its links are matched by a plain join
    that Spark splits.
    """
    edges = stored(_down(links), "edges")
    seen = _mark(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _down(links: DataFrame) -> DataFrame:
    """Links once each, from the larger to the smaller node."""
    return (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _down(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()

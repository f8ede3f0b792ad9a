"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import written


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """One step over distinct ``(u, v)`` with u > v: minimum of each vertex by partial aggregation, then a join."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # Each smaller neighbour, and the vertex itself, hangs on the least one.
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every vertex of the links ``(a, b)``; the root is the least vertex that it reaches.

    Every round is written, so lineage stays short; it ends when a round changes nothing (by number and hash of rows).
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        edges = written(_star(_star(edges, large=True), large=False), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())

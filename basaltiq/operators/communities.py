"""Communities by multilevel optimisation of modularity.

On the way up, a level lets single vertices join the neighbour with the largest gain and makes each star that arises one vertex of
the next, coarser graph, whose self-loops hold the weight inside. Levels end when no two vertices of the graph gain by joining. On the
way down, the communities of each finer graph are bettered by moves of its single vertices: both halves of them once on every level, and
on the finest one for as many rounds as are asked for, or until no move gains. Communities that have come apart are split at the end.

Moves of one round are made at once: up, those from one half of the vertices to the other (another half each level), so that
nothing moves away from where something comes to; down, those of half of the vertices. They count only if modularity has grown. Else the
moves that are best for both communities which they touch are made: no two of them share a community, so their gains add up exactly, and
modularity grows with every round. A round writes one table, in which every vertex has its community and its best move; everything is joins and
aggregations over edges and vertices, cut by tables in the shared folder; the driver sees one row of sums a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltiq.operators.graph import cut, reverse, weak_components

#: Gains below it are rounding.
LEAST_GAIN = 1e-12


def _symmetric(edges: DataFrame) -> DataFrame:
    """``a, b, w`` of an undirected weighted graph, each edge in both directions, without self-loops."""
    ways = edges.select("src", "dst", "weight").unionByName(reverse(edges).select("src", "dst", "weight")).where("src <> dst")
    return ways.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("weight").cast("double").alias("w"))


class _State:
    """One assignment ``own (v, k, loop, c)`` of a level: ``rows (v, k, loop, c, kc, inner, to, gain)``, every vertex with the size of its
    community, the weight between it and that, and its best move, null if it has none (of equal ones to the smallest community); its
    modularity and the number of moves. That is one table, made in one job, and one row of sums.

    Sizes travel with the vertices, so the edges are dealt twice: to what they lead to, and to where they come from."""

    def __init__(self, own: DataFrame, adjacent: DataFrame, total: float) -> None:
        placed = own.join(own.groupBy("c").agg(F.sum("k").alias("kc")), "c")
        ends = placed.select(F.col("v").alias("b"), F.col("c").alias("to"), F.col("kc").alias("ahead"))
        near = adjacent.join(ends, "b").select(F.col("a").alias("v"), "to", "ahead", "w").repartition("v").groupBy("v", "to", "ahead").agg(F.sum("w").alias("w"))
        inner = F.coalesce(F.max(F.when(F.col("to") == F.col("c"), F.col("w"))), F.lit(0.0)).alias("inner")
        best = F.min(F.when(F.col("to") != F.col("c"), F.struct((F.col("k") * F.col("ahead") / total - F.col("w")).alias("g"), "to"))).alias("m")
        found = placed.join(near, "v", "left").groupBy("v").agg(*[F.max(x).alias(x) for x in ("k", "loop", "c", "kc")], inner, best)
        gain = F.round(2 * (F.col("k") * (F.col("kc") - F.col("k")) / total - F.col("m.g") - F.col("inner")) / total, 15)
        moves = found.withColumn("gain", F.when(gain > LEAST_GAIN, gain))
        self.rows = cut(moves.select("v", "k", "loop", "c", "kc", "inner", F.when(F.col("gain").isNotNull(), F.col("m.to")).alias("to"), "gain"))
        # The square of a community's size is the sum of what its vertices' degrees times that size are.
        part = (F.col("inner") + 2 * F.col("loop")) / total - (F.col("k") / total) * (F.col("kc") / total)
        sums = self.rows.agg(F.sum(part).alias("q"), F.count("to").alias("n")).first()
        self.modularity, self.movable = sums.q or 0.0, sums.n

    def moved(self, now: Column) -> DataFrame:
        """``v, k, loop, c``, where the vertices for which ``now`` is not null have gone there."""
        return self.rows.select("v", "k", "loop", F.coalesce(now, F.col("c")).alias("c"))

    def apart(self) -> DataFrame:
        """The same with the moves that do not touch each other."""
        moves = _apart(self.rows.where("to is not null")).select("v", F.col("to").alias("now"))
        return cut(self.rows.join(moves, "v", "left").select("v", "k", "loop", F.coalesce("now", "c").alias("c")))


def _gains(state: _State, total: float) -> DataFrame:
    """``v, k, loop, c, to, gain``: every vertex with its best move."""
    return state.rows.select("v", "k", "loop", "c", "to", "gain")


def _apart(moves: DataFrame) -> DataFrame:
    """The moves that are the best for both communities which they touch."""
    rank = F.struct((-F.col("gain")).alias("g"), "v")
    touched = moves.select(F.explode(F.array("c", "to")).alias("t"), rank.alias("r")).groupBy("t").agg(F.min("r").alias("r"))
    first = touched.select(F.col("t").alias("c"), F.col("r.v").alias("leaves"))
    second = touched.select(F.col("t").alias("to"), F.col("r.v").alias("enters"))
    return moves.join(first, "c").join(second, "to").where("leaves = v and enters = v").select("v", "c", "to", "gain")


def _half(of: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(2))


def _settled(state: _State, adjacent: DataFrame, total: float, rounds: int, seed: int) -> _State:
    """The state after local moves."""
    for k in range(rounds):
        if not state.movable:
            break
        then = _State(state.moved(F.when(_half("v", seed) == k % 2, F.col("to"))), adjacent, total)
        if then.modularity <= state.modularity + LEAST_GAIN:
            then = _State(state.apart(), adjacent, total)
        if then.modularity <= state.modularity + LEAST_GAIN:
            break
        state = then
    return state


def _coarser(own: DataFrame, adjacent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose vertices are the communities of ``own (v, k, loop, c)``: its own ``v, k, loop``, and its edges."""
    ends = adjacent.join(own.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(own.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    joined = cut(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    within = joined.where("a = b").select(F.col("a").alias("c"), (F.col("w") / 2).alias("more"))
    whole = own.groupBy("c").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(within, "c", "left")
    return cut(whole.select(F.col("c").alias("v"), "k", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop"))), joined.where("a <> b")


def _connected(state: _State, adjacent: DataFrame) -> DataFrame:
    """``v, c``: each community split into its connected parts, which never lowers modularity; ``c`` is the least vertex."""
    of = state.rows.select("v", "c")
    links = adjacent.join(of.withColumnsRenamed({"v": "a", "c": "ca"}), "a").join(of.withColumnsRenamed({"v": "b", "c": "cb"}), "b").where("ca = cb and a < b")
    parts = weak_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return of.select("v").join(parts.withColumnRenamed("id", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("c"))


def multilevel(edges: DataFrame, *, rounds: int = 12, levels: int = 1000, starts: int = 1) -> tuple[DataFrame, float]:
    """``id, label`` for each vertex of ``edges (src, dst, weight)`` that has a neighbour (``label`` is a vertex of its community),
    and the modularity: the best of ``starts`` runs, which halve the vertices otherwise. Parallel edges and both directions add up;
    self-loops are ignored."""
    first = cut(_symmetric(edges))
    total = first.agg(F.sum("w").alias("w")).first().w
    return max((_run(first, total, rounds, levels, seed) for seed in range(starts)), key=lambda found: found[1])


def _run(first: DataFrame, total: float | None, rounds: int, levels: int, seed: int) -> tuple[DataFrame, float]:
    if not total:
        return first.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), 0.0
    single = lambda own: own.select("v", "k", "loop", F.col("v").alias("c"))
    adjacent, finer = first, []
    state = _State(single(cut(first.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k"), F.lit(0.0).alias("loop")))), first, total)
    while state.movable and len(finer) < levels:
        here = seed * 7919 + len(finer)
        for moved in (lambda: state.moved(F.when((_half("c", here) == 0) & (_half("to", here) == 1), F.col("to"))), state.apart):  # noqa: B023
            ahead = moved()
            own, edges = _coarser(ahead, adjacent)
            then = _State(single(own), edges, total)
            if better := then.modularity > state.modularity + LEAST_GAIN:
                break
        if not better:
            break
        finer.append((ahead, adjacent))
        state, adjacent = then, edges
    for k, (below, adjacent) in reversed(list(enumerate(finer))):
        # A vertex's community is that of the vertex which it has become a part of.
        labels = state.rows.select(F.col("v").alias("whole"), F.col("c").alias("label"))
        own = cut(below.withColumnRenamed("c", "whole").join(labels, "whole").select("v", "k", "loop", F.col("label").alias("c")))
        state = _settled(_State(own, adjacent, total), adjacent, total, 2 if k else rounds, seed * 7919 + k)
    parts = cut(_connected(state, first))
    return parts.select(F.col("v").alias("id"), F.col("c").alias("label")), modularity_of(first, parts, total)


def modularity_of(adjacent: DataFrame, labels: DataFrame, total: float) -> float:
    """Of ``labels (v, c)`` on a symmetric graph ``adjacent (a, b, w)`` of the weight ``total``."""
    ends = adjacent.join(labels.withColumnsRenamed({"v": "a", "c": "ca"}), "a").join(labels.withColumnsRenamed({"v": "b", "c": "cb"}), "b")
    of = ends.groupBy("ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    return of.agg(F.sum(F.col("inside") / total - (F.col("k") / total) * (F.col("k") / total)).alias("q")).first().q or 0.0


def numbered(sizes: DataFrame) -> DataFrame:
    """``label, size`` with ``community``: 0 for the largest, on ties the smaller label first. The order is that of range partitions,
    whose counts (a row each) are all that is added up before them."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(sizes.repartitionByRange(parts, F.desc("size"), F.col("label")).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    ahead = before.alias("x").join(before.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "label"))
    return ranged.join(ahead, "part").select("label", "size", (F.col("ahead") + place - 1).alias("community"))


def communities(vertices: DataFrame, edges: DataFrame, **options: int) -> DataFrame:
    """``id, community, size`` of all ``vertices (id)`` and ends of edges: numbers by falling size, on ties by the least member.
    A vertex without a neighbour is a community of its own."""
    labels, _ = multilevel(edges, **options)
    labels = cut(labels)
    known = vertices.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    all_ = cut(known.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    sizes = all_.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    order = numbered(sizes.select(F.col("least").alias("label"), "size"))
    named = sizes.select("label", "least").join(order.select(F.col("label").alias("least"), "size", "community"), "least")
    return all_.join(named.select("label", "size", "community"), "label").select("id", "community", "size")

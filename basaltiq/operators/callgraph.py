"""Scores, audits and exports of call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltiq.operators.graph import cut, reverse


def _degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def god_nodes(vertices: DataFrame, edges: DataFrame, *, least: int) -> DataFrame:
    own = vertices.join(_degrees(edges), "id", "left").na.fill(0, ["fan_in", "fan_out"])
    score = F.round(0.4 * F.col("fan_in") / 10.0 + 0.3 * F.col("fan_out") / 10.0 + 0.3 * F.col("size") / 50.0, 6)
    kind = F.when(F.col("fan_in") >= least + 1, "high").otherwise("medium")
    return own.where((F.col("fan_in") >= least) | (F.col("fan_out") >= least)).select("id", "fan_in", "fan_out", score.alias("score"), kind.alias("severity"))


def surprises(edges: DataFrame, labels: DataFrame, *, hub: int) -> DataFrame:
    simple = edges.where("src <> dst").select("src", "dst")
    degree = simple.unionByName(reverse(simple).select("src", "dst")).distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    own = labels.join(degree, "id")
    a = own.select(F.col("id").alias("src"), F.col("label").alias("la"), F.col("n").alias("na"))
    b = own.select(F.col("id").alias("dst"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    cross = F.when(F.col("la") != F.col("lb"), 0.5).otherwise(0.0)
    edge_of_hub = F.when((F.least("na", "nb") <= 2) & (F.greatest("na", "nb") >= hub), 0.4).otherwise(0.0)
    return simple.join(a, "src").join(b, "dst").select("src", "dst", F.round(0.1 + cross + edge_of_hub, 4).alias("score")).where("score > 0.4")


def stats(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("nodes"))
    both = nodes.crossJoin(edges.agg(F.count("*").alias("edges")))
    n, m = F.col("nodes").cast("double"), F.col("edges")
    return both.select("nodes", "edges", F.round(m / (n * (n - 1)), 8).alias("density"), F.round(2.0 * m / n, 6).alias("mean_degree"))


def blast_radius(reached: DataFrame) -> DataFrame:
    """``reached (id, depth)`` by reverse calls: nearer callers weigh more, ten points over the depth; without callers 0."""
    score = F.round(F.least(F.lit(100.0), 10 * F.coalesce(F.sum(F.when(F.col("depth") > 0, 1.0 / F.col("depth"))), F.lit(0.0))), 4)
    risk = F.when(F.col("score") >= 80, "critical").when(F.col("score") >= 60, "high").when(F.col("score") >= 40, "medium").otherwise("low")
    return reached.agg((F.count("*") - 1).alias("hit"), score.alias("score")).withColumn("risk", risk)


def entry_scores(vertices: DataFrame, edges: DataFrame, *, handler: str) -> DataFrame:
    """Share of outgoing calls, export and name; ``vertices (id, name, exported)``."""
    own = vertices.join(_degrees(edges), "id", "left").na.fill(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    ratio = F.when(total == 0, 0.0).otherwise(F.col("fan_out") / (total + 1.0))
    score = 0.40 * ratio + F.when(F.col("exported"), 0.20).otherwise(0.0) + F.when(F.col("name").rlike(handler), 0.25).otherwise(0.0)
    return own.select("id", F.round(100 * score, 4).alias("score"))


def taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, *, depth: int) -> DataFrame:
    """``source, sink, depth``: sinks within ``depth`` calls of a source."""
    frontier = cut(sources.select(F.col("id").alias("source"), "id"))
    found = None
    for level in range(1, depth + 1):
        frontier = cut(frontier.join(edges.select("src", "dst"), F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct())
        hit = frontier.join(sinks, "id", "left_semi").select("source", F.col("id").alias("sink"), F.lit(level).cast("long").alias("depth"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("source", "sink").agg(F.min("depth").alias("depth"))


def dot(edges: DataFrame) -> DataFrame:
    """A graph description of the given edges, which the caller has limited."""
    line = F.concat(F.lit('"'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('"'))
    rows = F.array_sort(F.collect_list(F.struct("src", "dst", line.alias("line"))))
    return edges.agg(F.concat(F.lit("digraph {"), F.array_join(F.transform(rows, lambda x: x["line"]), "; "), F.lit("}")).alias("dot"))


def betweenness(edges: DataFrame, *, sources: int | None = None) -> DataFrame:
    """``id, score``: dependency sums of shortest paths, from all vertices or from the ``sources`` with the smallest hashes.

    Breadth-first levels hold ``(s, id, ways)`` for every source, which is numbered; then dependencies are summed up from the last level
    to the first. Rows are sources times what they reach, dealt by vertex; what is seen is a bit for each of them, 64 sources of a vertex
    to a row. What passes along the edges is dealt once a level, each way; nothing goes to the driver but counts.
    """
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    chosen = ids if sources is None else ids.orderBy(F.xxhash64("id"), "id").limit(sources)
    level = cut(chosen.select(F.monotonically_increasing_id().alias("s"), "id", F.lit(1.0).alias("ways")))
    word, bit = F.shiftright("s", 6).alias("word"), F.expr("shiftleft(1L, cast(s & 63 as int))")
    levels, seen = [level], None
    while True:
        marks = level.groupBy("id", word).agg(F.bit_or(bit).alias("mask"))
        seen = cut(marks if seen is None else seen.unionByName(marks).groupBy("id", "word").agg(F.bit_or("mask").alias("mask")))
        ahead = level.join(links, F.col("id") == F.col("src")).select("s", word, F.col("dst").alias("id"), "ways")
        step = ahead.repartition("id", "word").groupBy("s", "word", "id").agg(F.sum("ways").alias("ways"))
        fresh = step.join(seen, ["id", "word"], "left").where(F.col("mask").isNull() | (F.col("mask").bitwiseAND(bit) == 0))
        level = cut(fresh.select("s", "id", "ways"))
        if level.isEmpty():
            break
        levels.append(level)
    passed, found = None, None
    for level in reversed(levels[1:]):
        # What has passed to vertices of other levels is not along shortest paths; it finds no row here.
        own = level.withColumn("owed", F.lit(0.0)) if passed is None else level.join(passed, ["s", "id"], "left").withColumn("owed", F.coalesce(F.col("ways") * F.col("passed"), F.lit(0.0)))
        own = cut(own.select("s", "id", "owed", ((1 + F.col("owed")) / F.col("ways")).alias("share")))
        found = own.select("id", "owed") if found is None else found.unionByName(own.select("id", "owed"))
        passed = own.join(links, F.col("id") == F.col("dst")).groupBy("s", F.col("src").alias("id")).agg(F.sum("share").alias("passed"))
    if found is None:
        return ids.select("id", F.lit(0.0).alias("score"))
    owing = found.groupBy("id").agg(F.round(F.sum("owed"), 6).alias("score"))
    return ids.join(owing, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def processes(edges: DataFrame, scores: DataFrame, *, branching: int = 4, depth: int = 10, least: int = 3, most: int = 75, score: float = 50.0) -> DataFrame:
    """``entry, trace, steps``: what the ``most`` best entry points of ``scores (id, score)`` with ``score`` or more reach, in breadth-first order
    along the heaviest ``branching`` calls of each function; of equal traces the best entry's stays, and short ones leave."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    kept = cut(edges.where("src <> dst").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branching).select("src", "dst", "rank"))
    chosen = cut(scores.where(F.col("score") >= score).orderBy(F.desc("score"), "id").limit(most).select("id", "score"))
    seen = cut(chosen.select(F.col("id").alias("entry"), "id", F.lit(0).cast("long").alias("place"), F.lit(0).alias("level")))
    for level in range(1, depth + 1):
        ahead = seen.where(F.col("level") == level - 1).join(kept, F.col("id") == F.col("src")).groupBy("entry", F.col("dst").alias("id")).agg(F.min(F.struct("place", "rank")).alias("way"))
        fresh = ahead.join(seen.select("entry", "id"), ["entry", "id"], "left_anti")
        # Places of a level follow those of the one before; only their order counts. An entry's rows are few: 4 calls each way.
        order = F.row_number().over(Window.partitionBy("entry").orderBy("way")).cast("long")
        step = cut(fresh.select("entry", "id", (F.lit(level) * (1 << 40) + order).alias("place"), F.lit(level).alias("level")))
        if step.isEmpty():
            break
        seen = cut(seen.unionByName(step))
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ">")
    found = seen.groupBy("entry").agg(trace.alias("trace"), F.count("*").alias("steps")).where(F.col("steps") >= least)
    best = found.join(chosen.withColumnRenamed("id", "entry"), "entry").groupBy("trace").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry", "steps")).alias("b"))
    return best.select("b.entry", "trace", "b.steps")

"""Graph operators over ``edges (src, dst, weight)``: frontier loops, recursion, ranking and components.

Loops collect only counts. Lineage is cut by tables written to the shared folder every round.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session, whose executors see the driver's folders, may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="basaltiq-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, *, depth: int | None = None) -> DataFrame:
    """``id, depth``: everything reachable from ``seeds (id)``, at its least depth; unbounded if ``depth`` is None."""
    links = cut(edges.select("src", "dst").distinct())
    spark, path = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/graph-{uuid.uuid4().hex}"
    frontier, level = cut(seeds.select("id", F.lit(0).cast("long").alias("depth")).distinct()), 0
    seen = lambda: spark.read.schema(frontier.schema).parquet(path)
    frontier.write.mode("append").parquet(path)
    while depth is None or level < depth:
        level += 1
        step = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id")).distinct().join(seen(), "id", "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(level).cast("long")))
        if frontier.isEmpty():
            break
        frontier.write.mode("append").parquet(path)  # levels are added to one folder; none is written twice
    return seen()


def layers(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, layer``: topological waves. Vertices without predecessors have layer 0; one whose predecessors are all done has one more
    than the last of them. What never becomes ready, as it is on a cycle or hangs on one, has none.

    A wave follows only the edges that leave it and appends the predecessors it has met; nothing that is done is written again."""
    spark = edges.sparkSession
    links = cut(edges.select("src", "dst").distinct())
    ends = links.select(F.explode(F.array("src", "dst")).alias("id"))
    ids = cut((ends if vertices is None else ends.unionByName(vertices.select("id"))).distinct())
    need = cut(links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need")))
    met_at, done_at = (f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}" for _ in range(2))
    wave, level = cut(ids.join(need, "id", "left_anti")), 0
    while True:
        wave.withColumn("layer", F.lit(level).cast("long")).write.mode("append").parquet(done_at)
        step = cut(wave.join(links, wave["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met")))
        if step.isEmpty():
            break
        step.write.mode("append").parquet(met_at)
        met = spark.read.schema(step.schema).parquet(met_at).join(step.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("met").alias("met"))
        wave, level = cut(met.join(need, "id").where(F.col("met") == F.col("need")).select("id")), level + 1
    done = spark.read.schema(f"id {dict(ids.dtypes)['id']}, layer long").parquet(done_at)
    return ids.join(done, "id", "left")


def shortest_paths(edges: DataFrame, pairs: DataFrame, *, depth: int = 10) -> DataFrame:
    """``a, b, path, len``: for each of ``pairs (a, b)`` a shortest path of at most ``depth`` edges, on ties the least by its vertices.
    Pairs without one have no row; a vertex's path to itself is of length 0.

    Search goes from both ends, a level of each side in turn. A level keeps the least parent of each vertex it reaches; sides meet
    where a vertex has been reached from both, and least paths are traced back from there, one parent a join."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    open_ = cut(pairs.select("a", "b").distinct())
    side = lambda end: open_.select("a", "b", F.col(end).alias("id"), F.lit(0).alias("d"))
    ahead, back = [cut(side("a"))], [cut(side("b"))]
    seen = {"ahead": ahead[0].select("a", "b", "id"), "back": back[0].select("a", "b", "id")}
    lengths = cut(open_.where("a = b").withColumn("len", F.lit(0)))
    left = cut(open_.where("a <> b"))
    for n in range(1, depth + 1):
        name, levels, own, far = ("ahead", ahead, "src", "dst") if n % 2 else ("back", back, "dst", "src")
        other = back if n % 2 else ahead
        step = levels[-1].join(left, ["a", "b"], "left_semi").join(links, F.col("id") == F.col(own)).select("a", "b", F.col(far).alias("id")).distinct()
        fresh = cut(step.join(seen[name], ["a", "b", "id"], "left_anti").withColumn("d", F.lit(len(levels))))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen[name] = seen[name].unionByName(fresh.select("a", "b", "id"))
        # The other side's last level is the only one that this level can meet first.
        met = cut(fresh.join(other[-1].select("a", "b", "id"), ["a", "b", "id"]).select("a", "b").distinct().withColumn("len", F.lit(n)))
        lengths = cut(lengths.unionByName(met))
        left = cut(left.join(met, ["a", "b"], "left_anti"))
        if left.isEmpty():
            break
    return _least_paths(links, lengths, ahead, back)


def _least_paths(links: DataFrame, lengths: DataFrame, ahead: list[DataFrame], back: list[DataFrame]) -> DataFrame:
    """Along vertices whose distances from both ends add up to the length: from the start, the least next vertex each time."""
    # Distances to the end: those of the backward levels, and one more than the next vertex's for the forward ones. A pair's levels
    # end where it has met, so both may hold what is ``k`` edges from the end.
    near = [cut(back[0].join(lengths, ["a", "b"], "left_semi").select("a", "b", "id"))]
    longest = lengths.agg(F.max("len").alias("m")).first().m or 0
    for k in range(1, longest + 1):
        rest = [level.join(lengths.where(F.col("len") == k + d), ["a", "b"]) for d, level in enumerate(ahead)]
        some = rest[0].select("a", "b", "id")
        for x in rest[1:]:
            some = some.unionByName(x.select("a", "b", "id"))
        next_ = near[k - 1].select("a", "b", F.col("id").alias("dst"))
        found = some.join(links, F.col("id") == F.col("src")).join(next_, ["a", "b", "dst"]).select("a", "b", "id")
        if k < len(back):
            found = found.unionByName(back[k].join(lengths, ["a", "b"], "left_semi").select("a", "b", "id"))
        near.append(cut(found.distinct()))
    paths_ = cut(lengths.select("a", "b", "len", F.array("a").alias("path")))
    for n in range(1, longest + 1):
        to = None
        for k in range(min(longest - n + 1, len(near))):
            level = near[k].withColumn("rest", F.lit(k))
            to = level if to is None else to.unionByName(level)
        going = paths_.where(F.col("len") >= n).withColumn("rest", F.col("len") - n)
        ways = going.join(links, F.element_at("path", -1) == F.col("src")).join(to.withColumnRenamed("id", "dst"), ["a", "b", "dst", "rest"])
        best = ways.groupBy("a", "b").agg(F.min("dst").alias("next"))
        paths_ = cut(paths_.join(best, ["a", "b"], "left").select("a", "b", "len", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path")))
    return paths_.select("a", "b", "path", F.col("len").cast("long").alias("len"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "dst_", "dst": "src"}).withColumnRenamed("dst_", "dst")


def explore(edges: DataFrame, seeds: DataFrame, *, direction: str = "both", depth: int = 1) -> DataFrame:
    """``id, depth, fan_in, fan_out``: what lies within ``depth`` edges of the seeds, along them (out), against them (in) or both
    ways; the caller has filtered the relations, and degrees count those that are left."""
    own = cut(edges.select("src", "dst"))
    ways = {"out": own, "in": reverse(own).select("src", "dst"), "both": own.unionByName(reverse(own).select("src", "dst"))}
    found = reach(ways[direction], seeds, depth=depth)
    fan_in, fan_out = own.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")), own.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    return found.join(fan_in, "id", "left").join(fan_out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``path array<long>, len``: simple paths of 1 to ``depth`` edges from ``seeds (id)``."""
    links = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    level = seeds.select(F.array(F.col("id").cast("long")).alias("path"))
    out = None
    for n in range(1, depth + 1):
        level = cut(level.join(links, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        tagged = level.withColumn("len", F.lit(n).cast("long"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """``path, len``: simple cycles of 2 to ``longest`` edges, each once, from its least vertex."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    level = links.where("src < dst").select(F.array("src", "dst").alias("path"))
    out = None
    for n in range(2, longest + 1):
        closed = level.join(links, (F.element_at("path", -1) == links["src"]) & (F.element_at("path", 1) == links["dst"])).select("path", F.lit(n).cast("long").alias("len"))
        out = closed if out is None else out.unionByName(closed)
        if n < longest:
            level = cut(level.join(links, F.element_at("path", -1) == links["src"]).where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
    return out


def page_rank(vertices: DataFrame, edges: DataFrame, *, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """``id, rank`` after fixed rounds; weights split a vertex's rank, and dangling rank is spread evenly."""
    n = vertices.count()
    ids = cut(vertices.select("id").distinct())
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    senders = cut(total.select(F.col("src").alias("id")))
    for _ in range(rounds):
        ranks = cut(ranks)
        dangling = ranks.join(senders, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = ranks.join(share, ranks["id"] == share["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        ranks = ids.join(got, ids["id"] == got["dst"], "left").select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + dangling / n)).alias("rank"))
    return ranks


def label_propagation(edges: DataFrame, *, rounds: int = 3) -> DataFrame:
    """``id, label``: synchronous propagation; the heaviest label among neighbours wins, the smallest on ties."""
    both = cut(edges.select("src", "dst", "weight").unionByName(reverse(edges).select("src", "dst", "weight")).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        labels = cut(labels)
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        labels = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("id", F.col("b.label").alias("label"))
    return labels


def communities(edges: DataFrame, *, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``label, size, internal, cohesion`` of communities by label propagation; and one row ``communities,
    modularity``. ``cohesion`` is the share of possible links that exist inside; weights count once for each direction."""
    labels = cut(label_propagation(edges, rounds=rounds))
    both = cut(edges.select("src", "dst", "weight").unionByName(reverse(edges).select("src", "dst", "weight")).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    ends = both.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    same = F.col("a") == F.col("b")
    of = cut(ends.groupBy(F.col("a").alias("label")).agg(F.sum("weight").alias("total"), F.sum(F.when(same, F.col("weight")).otherwise(0)).alias("inside"), F.count_if(same & (F.col("src") < F.col("dst"))).alias("internal")))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    rows = size.join(of, "label").select("label", "size", "internal", F.round(F.when(F.col("size") > 1, F.col("internal") / possible).otherwise(0.0), 6).alias("cohesion"))
    m = of.agg(F.sum("total").alias("m"))
    part = F.col("inside") / F.col("m") - (F.col("total") / F.col("m")) * (F.col("total") / F.col("m"))
    return rows, of.crossJoin(F.broadcast(m)).agg(F.count("*").alias("communities"), F.round(F.sum(part), 6).alias("modularity"))


def _mark(links: DataFrame) -> tuple:
    """Number and hash of the rows, which no sum of large ids can overflow."""
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def weak_components(edges: DataFrame) -> DataFrame:
    """``id, component``: least reachable vertex, by star contraction: larger neighbours hang on a vertex's least neighbour,
    then smaller ones and the vertex itself do. The rounds are logarithmic in the vertices, whatever the diameter."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    links = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = cut(small.where("u <> v").distinct())
        now = _mark(links)
        if now == before:
            return ids.join(links, ids["id"] == links["u"], "left").select("id", F.coalesce("v", "id").alias("component"))
        before = now


def clustering(edges: DataFrame) -> DataFrame:
    """``id, degree, triangles, coefficient`` over the simple undirected graph."""
    pairs = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degree = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")))
    # From the vertex of smaller degree to that of larger: a hub then has few outgoing edges, and wedges stay few.
    end = lambda c: degree.select(F.col("id").alias(c), F.struct(F.col("degree"), F.col("id")).alias(f"d{c}"))
    led = pairs.join(end("a"), "a").join(end("b"), "b").select(F.least("da", "db")["id"].alias("a"), F.greatest("da", "db")["id"].alias("b"))
    led = cut(led)
    x, y, z = led.alias("x"), led.alias("y"), led.alias("z")
    triangles = x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("z.a") == F.col("x.a")) & (F.col("z.b") == F.col("y.b")))
    each = triangles.select(F.explode(F.array("x.a", "x.b", "y.b")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    coefficient = F.when(F.col("degree") > 1, 2.0 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return degree.join(each, "id", "left").select("id", "degree", t.alias("triangles"), F.round(coefficient, 6).alias("coefficient"))


def ancestry(links: DataFrame) -> DataFrame:
    """``id, root, depth, cyclic`` for every end of ``links (id, parent)``: the topmost ancestor and how many steps away it is. What is
    on a cycle of parents or below one has neither. Of several parents the least counts; a null parent is none.

    Pointers double each round, so chains of n steps take log2(n) rounds; only what has not arrived is joined again."""
    up = links.where("id is not null").groupBy("id").agg(F.min("parent").alias("to"))
    above = up.where("to is not null").select(F.col("to").alias("id")).join(up.select("id"), "id", "left_anti").distinct().withColumn("to", F.lit(None).cast(dict(up.dtypes)["to"]))
    own = cut(up.unionByName(above))
    roots = own.where("to is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    arrived = cut(roots)
    going = cut(own.where("to is not null").select("id", "to", F.lit(1).cast("long").alias("hops")))
    left, rounds = going.count(), 0
    most = max(1, left).bit_length() + 1
    while left and rounds < most:
        at_root = arrived.select(F.col("id").alias("to"), "root", F.col("depth").alias("more"))
        arrived = cut(arrived.unionByName(going.join(at_root, "to").select("id", "root", (F.col("hops") + F.col("more")).alias("depth"))))
        going = going.join(arrived.select("id"), "id", "left_anti")
        ahead = going.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        # A pointer whose end has just arrived stays; the next round takes the rest of its way from there.
        going = cut(going.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        left, rounds = going.count(), rounds + 1
    return own.select("id").join(arrived, "id", "left").select("id", "root", "depth", F.col("root").isNull().alias("cyclic"))

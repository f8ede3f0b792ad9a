"""Graph queries over the call graph (G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators import callgraph, communities, extract, graph
from basaltiq.registry import CORE
from basaltiq.sources.tables import call_edges, call_edges_sql, read

Q = CORE.query
CG = call_edges_sql()
SEED = "(SELECT min(src) FROM edges)"
#: The function that most others call; it has callers.
CALLED = "(SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _seed(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("src").alias("id"))


def _called(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


@Q(f"WITH {CG} SELECT dst AS callee, weight FROM edges WHERE src = {SEED}")
def direct_callees(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return e.join(F.broadcast(_seed(e)), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("callee"), "weight")


@Q(f"WITH RECURSIVE {CG}, r(id) AS (SELECT {SEED} UNION SELECT dst FROM edges JOIN r ON src = id) SELECT id FROM r")
def transitive_callees(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return graph.reach(e, _seed(e)).select("id")


@Q(f"WITH RECURSIVE {CG}, r(id, depth) AS (SELECT {CALLED}, 0::BIGINT UNION SELECT src, depth + 1 FROM edges JOIN r ON dst = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def bounded_callers(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return graph.reach(graph.reverse(e), _called(e), depth=3)


@Q(f"WITH RECURSIVE {CG}, r(path, len) AS (SELECT [{SEED}], 0::BIGINT UNION ALL SELECT list_append(path, dst), len + 1 FROM edges JOIN r ON src = path[-1] WHERE len < 3 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, len FROM r WHERE len > 0")
def execution_flow(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return graph.paths(e, _seed(e), 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "len")


TRAVERSE = """WITH RECURSIVE walk(id, depth) AS (
  SELECT CAST(min(src) AS BIGINT), 0L FROM call_edges UNION ALL SELECT CAST(e.dst AS BIGINT), w.depth + 1L FROM walk w JOIN call_edges e ON e.src = w.id WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM walk GROUP BY id"""


@Q(f"WITH RECURSIVE {CG}, r(id, depth) AS (SELECT {SEED}, 0::BIGINT UNION ALL SELECT dst, depth + 1 FROM edges JOIN r ON src = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def recursive_sql_traversal(spark: SparkSession, d: str) -> DataFrame:
    graph.cut(call_edges(spark, d)).createOrReplaceTempView("call_edges")
    return spark.sql(TRAVERSE)


@Q(f"WITH RECURSIVE {CG}, ends AS (SELECT {SEED} AS a, (SELECT max(dst) FROM edges WHERE src IN (SELECT dst FROM edges WHERE src = {SEED})) AS b), r(path, len) AS (SELECT [a], 0::BIGINT FROM ends UNION ALL SELECT list_append(path, dst), len + 1 FROM edges JOIN r ON src = path[-1] WHERE len < 4 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, len FROM r, ends WHERE path[-1] = b AND len > 0")
def call_chain(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    near = e.join(_seed(e), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("m"))
    end = e.join(near, F.col("src") == F.col("m"), "left_semi").agg(F.max("dst").alias("b"))
    found = graph.paths(e, _seed(e), 4).join(F.broadcast(end), F.element_at("path", -1) == F.col("b"))
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "len")


@Q(f"WITH RECURSIVE {CG}, r(id, dist) AS (SELECT {SEED}, 0::BIGINT UNION SELECT dst, dist + 1 FROM edges JOIN r ON src = id WHERE dist < 6) SELECT id, min(dist) AS dist FROM r GROUP BY 1")
def shortest_distances(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return graph.reach(e, _seed(e), depth=6).withColumnRenamed("depth", "dist")


@Q(f"WITH RECURSIVE {CG}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(id, depth) AS (SELECT {SEED}, 0::BIGINT UNION SELECT dst, depth + 1 FROM b JOIN r ON src = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def focus_subgraph(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    both = e.select("src", "dst").unionByName(graph.reverse(e).select("src", "dst"))
    return graph.reach(both, _seed(e), depth=2)


@Q("SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def class_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent")))


@Q("SELECT p_partkey AS id FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) OR p_size = 50")
def overridden_functions(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    again = p.groupBy("p_name").count().where("count > 1").select("p_name", F.lit(True).alias("again"))
    return p.join(again, "p_name", "left").where("again or p_size = 50").select(F.col("p_partkey").alias("id"))


@Q(f"WITH {CG} SELECT dst AS module, count(*) AS importers, string_agg(src::VARCHAR, ',' ORDER BY src) AS names FROM edges GROUP BY 1 HAVING count(*) >= 4")
def module_importers(spark: SparkSession, d: str) -> DataFrame:
    per = call_edges(spark, d).groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("importers"), F.array_sort(F.collect_list("src")).alias("n"))
    return per.where("importers >= 4").select("module", "importers", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("names"))


@Q(f"WITH {CG} SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")), "id", "left_anti")


@Q("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 10")
def most_complex(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").orderBy(F.desc("p_size"), "p_partkey").limit(10).select("p_partkey", "p_size")


def _rank_sql(rounds: int) -> str:
    steps = [f"""r{k} AS (SELECT p_partkey AS id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM edges)) / n) AS rank
FROM part CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank * p) AS got FROM r{k - 1} JOIN share ON id = src GROUP BY 1) g ON g.dst = p_partkey)""" for k in range(1, rounds + 1)]
    return f"""WITH {CG}, c AS (SELECT count(*)::DOUBLE AS n FROM part), share AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edges),
r0 AS (SELECT p_partkey AS id, 1.0 / n AS rank FROM part, c), {", ".join(steps)} SELECT id, round(rank, 7) AS rank FROM r{rounds}"""


@Q(_rank_sql(5))
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return graph.page_rank(v, graph.cut(call_edges(spark, d))).select("id", F.round("rank", 7).alias("rank"))


@Q(f"""WITH {CG}, o AS (SELECT src AS id, count(*) AS n, sum(weight) AS w FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n, sum(weight) AS w FROM edges GROUP BY 1),
x AS (SELECT p_partkey AS id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, p_size AS size FROM part LEFT JOIN o ON o.id = p_partkey LEFT JOIN i ON i.id = p_partkey)
SELECT id, fan_in, fan_out, round(0.4 * fan_in / 10.0 + 0.3 * fan_out / 10.0 + 0.3 * size / 50.0, 6) AS score, CASE WHEN fan_in >= 6 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE fan_in >= 5 OR fan_out >= 5""")
def god_node_audit(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.god_nodes(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), graph.cut(call_edges(spark, d)), least=5)


@Q(f"""WITH {CG}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)
SELECT a.src::VARCHAR || '>' || a.dst AS path, 2::BIGINT AS len FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src::VARCHAR || '>' || a.dst || '>' || b.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst
UNION ALL SELECT a.src::VARCHAR || '>' || a.dst || '>' || b.dst || '>' || c.dst, 4 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src JOIN e f ON c.dst = f.src AND f.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst <> b.dst AND a.dst <> c.dst AND b.dst <> c.dst""")
def simple_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(graph.cut(call_edges(spark, d)), 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "len")


def _labels_sql(rounds: int) -> str:
    steps = [f"l{k} AS (SELECT src AS id, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY sum(weight) DESC, label) AS r FROM both_ JOIN l{k - 1} ON dst = id GROUP BY src, label) WHERE r = 1)" for k in range(1, rounds + 1)]
    return f"""WITH {CG}, both_ AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) WHERE src <> dst GROUP BY 1, 2),
l0 AS (SELECT DISTINCT src AS id, src AS label FROM both_), {", ".join(steps)}"""


@Q(_labels_sql(3) + " SELECT id, label FROM l3")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(graph.cut(call_edges(spark, d)))


COMMUNITIES = ", x AS (SELECT b.src, b.dst, b.weight, p.label AS a, q.label AS b FROM both_ b JOIN l3 p ON b.src = p.id JOIN l3 q ON b.dst = q.id), c AS (SELECT a AS label, sum(weight) AS total, sum(CASE WHEN a = b THEN weight ELSE 0 END) AS inside, count(*) FILTER (WHERE a = b AND src < dst) AS internal FROM x GROUP BY 1), z AS (SELECT label, count(*) AS size FROM l3 GROUP BY 1)"


@Q(_labels_sql(3) + COMMUNITIES + " SELECT label, size, internal, round(CASE WHEN size > 1 THEN internal / (size * (size - 1) / 2) ELSE 0 END, 6) AS cohesion FROM z JOIN c USING (label) ORDER BY size DESC, label LIMIT 20")
def largest_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.cut(call_edges(spark, d)))[0].orderBy(F.desc("size"), "label").limit(20)


@Q(_labels_sql(3) + COMMUNITIES + " SELECT count(*) AS communities, round(sum(inside / m - (total / m) * (total / m)), 6) AS modularity FROM c, (SELECT sum(total) AS m FROM c)")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.cut(call_edges(spark, d)))[1]


@Q(_labels_sql(3) + """, deg AS (SELECT src AS id, count(*) AS n FROM both_ GROUP BY 1), x AS (SELECT e.src, e.dst, 0.1 + CASE WHEN a.label <> b.label THEN 0.5 ELSE 0 END + CASE WHEN least(p.n, q.n) <= 2 AND greatest(p.n, q.n) >= 5 THEN 0.4 ELSE 0 END AS score
FROM edges e JOIN l3 a ON e.src = a.id JOIN l3 b ON e.dst = b.id JOIN deg p ON e.src = p.id JOIN deg q ON e.dst = q.id WHERE e.src <> e.dst)
SELECT src, dst, round(score, 4) AS score FROM x WHERE score > 0.4 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def surprising_edges(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return callgraph.surprises(e, graph.label_propagation(e), hub=5).orderBy(F.desc("score"), "src", "dst").limit(10)


def _components_sql(rounds: int) -> str:
    """Least labels spread over one edge a round; ``rounds`` exceeds any diameter here."""
    steps = [f"l{k} AS MATERIALIZED (SELECT a.id, least(a.o, min(b.o)) AS o FROM l{k - 1} a JOIN b_ ON b_.src = a.id JOIN l{k - 1} b ON b_.dst = b.id GROUP BY a.id, a.o)" for k in range(1, rounds + 1)]
    return f"WITH {CG}, b_ AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT DISTINCT src AS id, src AS o FROM b_), {', '.join(steps)} SELECT id, o AS component FROM l{rounds}"


@Q(_components_sql(40))
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(graph.cut(call_edges(spark, d)))


@Q(f"""WITH {CG}, p AS (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM edges WHERE src <> dst), deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1),
t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b), c AS (SELECT id, count(*) AS n FROM (SELECT i AS id FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t) GROUP BY 1)
SELECT deg.id, degree, coalesce(n, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM deg LEFT JOIN c ON deg.id = c.id""")
def clustering_coefficient(spark: SparkSession, d: str) -> DataFrame:
    return graph.clustering(graph.cut(call_edges(spark, d)))


@Q(f"WITH {CG}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1.0)), 8) AS density, round(2.0 * count(*) / (SELECT count(*) FROM v), 6) AS mean_degree FROM edges")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.stats(graph.cut(call_edges(spark, d)))


@Q(f"""WITH RECURSIVE {CG}, r(id, depth) AS (SELECT {CALLED}, 0::BIGINT UNION SELECT src, depth + 1 FROM edges JOIN r ON dst = id WHERE depth < 4), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1),
x AS (SELECT count(*) - 1 AS hit, round(least(100, 10 * coalesce(sum(1.0 / depth) FILTER (WHERE depth > 0), 0)), 4) AS score FROM m) SELECT hit, score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS risk FROM x""")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    return callgraph.blast_radius(graph.reach(graph.reverse(e), _called(e), depth=4))


@Q(f"""WITH {CG}, i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1), x AS (SELECT p_partkey AS id, p_name AS name, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees, p_size > 25 AS exported FROM part LEFT JOIN i ON i.id = p_partkey LEFT JOIN o ON o.id = p_partkey)
SELECT id, round(100 * (0.40 * CASE WHEN callers + callees = 0 THEN 0 ELSE callees / (callers + callees + 1.0) END + CASE WHEN exported THEN 0.20 ELSE 0 END + CASE WHEN regexp_matches(name, '[05]$') THEN 0.25 ELSE 0 END), 4) AS score FROM x""")
def entry_point_score(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("exported"))
    return callgraph.entry_scores(p, graph.cut(call_edges(spark, d)), handler="[05]$")


@Q(f"WITH RECURSIVE {CG}, s AS (SELECT p_partkey AS id FROM part WHERE p_size = 1), k AS (SELECT p_partkey AS id FROM part WHERE p_size = 50), r(source, id, depth) AS (SELECT id, id, 0::BIGINT FROM s UNION SELECT source, dst, depth + 1 FROM edges JOIN r ON src = r.id WHERE depth < 3) SELECT source, r.id AS sink, min(depth) AS depth FROM r JOIN k ON r.id = k.id WHERE depth > 0 GROUP BY 1, 2")
def taint_flow(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return callgraph.taint(graph.cut(call_edges(spark, d)), p.where("p_size = 1").select(F.col("p_partkey").alias("id")), p.where("p_size = 50").select(F.col("p_partkey").alias("id")), depth=3)


@Q(f"WITH {CG} SELECT 'digraph {{' || string_agg('\"' || src || '\" -> \"' || dst || '\"', '; ' ORDER BY src, dst) || '}}' AS dot FROM (SELECT * FROM edges ORDER BY weight DESC, src, dst LIMIT 20)")
def dot_export(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.dot(call_edges(spark, d).orderBy(F.desc("weight"), "src", "dst").limit(20))


@Q(f"WITH {CG}, g AS (SELECT dst AS module, count(*) AS in_degree FROM edges GROUP BY 1) SELECT module, in_degree, CASE WHEN in_degree >= 8 THEN 'high' ELSE 'god' END AS kind FROM g WHERE in_degree >= 5")
def module_graph(spark: SparkSession, d: str) -> DataFrame:
    g = call_edges(spark, d).groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("in_degree")).where("in_degree >= 5")
    return g.withColumn("kind", F.when(F.col("in_degree") >= 8, "high").otherwise("god"))


@Q("SELECT DISTINCT p_type AS variable, p_brand AS scope FROM part WHERE contains(lower(p_type), 'st') ORDER BY 1, 2 LIMIT 25")
def variable_scope(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").where(F.lower("p_type").contains("st"))
    return p.select(F.col("p_type").alias("variable"), F.col("p_brand").alias("scope")).distinct().orderBy("variable", "scope").limit(25)


@Q()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.betweenness(graph.cut(call_edges(spark, d)), sources=100)


@Q()
def processes(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("exported"))
    return callgraph.processes(e, callgraph.entry_scores(p, e, handler="g$"))


@Q("""WITH m AS (SELECT 'c' || c_custkey AS name, 'm' || (c_custkey % 5) AS method, 'n' || c_nationkey AS up, 'r' || n_regionkey AS top FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT 'n' || n_nationkey AS name, 'm' || (n_nationkey % 5) AS method, 'r' || n_regionkey AS up FROM nation), r AS (SELECT 'r' || r_regionkey AS name, 'm' || (r_regionkey % 5) AS method FROM region)
SELECT m.name, m.method, CASE WHEN n.name IS NOT NULL THEN n.name ELSE r.name END AS overridden FROM m LEFT JOIN n ON m.up = n.name AND m.method = n.method LEFT JOIN r ON m.top = r.name AND m.method = r.method WHERE n.name IS NOT NULL OR r.name IS NOT NULL
UNION ALL SELECT n.name, n.method, r.name FROM n JOIN r ON n.up = r.name AND n.method = r.method""")
def override_detection(spark: SparkSession, d: str) -> DataFrame:
    """Customers derive from their nation, nations from their region."""
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    rows = [("customer", "c", "c_custkey", F.array(text("n", "c_nationkey"))), ("nation", "n", "n_nationkey", F.array(text("r", "n_regionkey"))), ("region", "r", "r_regionkey", F.array().cast("array<string>"))]
    classes = [read(spark, d, t).select(text(head, key).alias("name"), up.alias("bases"), F.concat(F.lit("m"), (F.col(key) % 5).cast("string")).alias("method")) for t, head, key, up in rows]
    both = reduce(DataFrame.unionByName, classes)
    return extract.overrides(extract.mro(both.select("name", "bases")), both.select("name", "method"))


def _least_paths_sql(depth: int) -> str:
    """The least of the shortest paths, level by level: its beginning is the least path of the vertex before."""
    levels = [f"""p{k} AS MATERIALIZED (SELECT dst AS id, min(list_append(path, dst)) AS path FROM p{k - 1} JOIN edges ON src = id WHERE dst NOT IN ({" UNION ALL ".join(f"SELECT id FROM p{j}" for j in range(k))}) GROUP BY 1)""" for k in range(1, depth + 1)]
    return f"WITH {CG}, p0 AS (SELECT {SEED} AS id, [{SEED}] AS path), {', '.join(levels)} SELECT a, id AS b, array_to_string(path, '>') AS path, len FROM (SELECT {SEED} AS a), (" + " UNION ALL ".join(f"SELECT id, path, {k}::BIGINT AS len FROM p{k}" for k in range(depth + 1)) + ") WHERE id % 20 = 0"


@Q(_least_paths_sql(7))
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """From the first caller to every part whose key 20 divides, within seven calls, with the vertices on the way."""
    e = graph.cut(call_edges(spark, d))
    ends = read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("b"))
    found = graph.shortest_paths(e, ends.join(F.broadcast(_seed(e).withColumnRenamed("id", "a"))), depth=7)
    return found.select("a", "b", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "len")


def _layers_sql(waves: int) -> str:
    """``waves`` exceeds the depth of any acyclic part here."""
    steps = [f"w{k} AS MATERIALIZED (SELECT * FROM w{k - 1} UNION ALL SELECT id, {k}::BIGINT FROM v WHERE id NOT IN (SELECT id FROM w{k - 1}) AND id NOT IN (SELECT dst FROM edges WHERE src NOT IN (SELECT id FROM w{k - 1})))" for k in range(1, waves + 1)]
    return f"WITH {CG}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), w0 AS MATERIALIZED (SELECT id, 0::BIGINT AS layer FROM v WHERE id NOT IN (SELECT dst FROM edges)), {', '.join(steps)} SELECT v.id, layer, layer IS NULL AS cyclic FROM v LEFT JOIN w{waves} w ON v.id = w.id"


@Q(_layers_sql(30))
def graph_layers(spark: SparkSession, d: str) -> DataFrame:
    """Topological waves; the graph is acyclic if no vertex is ``cyclic``, that is on a cycle or behind one."""
    return graph.layers(graph.cut(call_edges(spark, d))).withColumn("cyclic", F.col("layer").isNull())


@Q()
def modular_communities(spark: SparkSession, d: str) -> DataFrame:
    """Multilevel modularity over all parts; those without calls are communities of their own."""
    return communities.communities(read(spark, d, "part").select(F.col("p_partkey").alias("id")), graph.cut(call_edges(spark, d)))


@Q("""WITH RECURSIVE up AS (SELECT client_id AS id, min(nullif(master_id, client_id)) AS parent FROM clients WHERE client_id IS NOT NULL GROUP BY 1), own AS (SELECT * FROM up UNION ALL SELECT DISTINCT parent, NULL::BIGINT FROM up WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM up)),
r(id, above, depth) AS (SELECT id, id, 0::BIGINT FROM own UNION ALL SELECT r.id, own.parent, depth + 1 FROM r JOIN own ON own.id = r.above WHERE own.parent IS NOT NULL AND depth < 200),
t AS (SELECT r.id, r.above AS root, r.depth FROM r JOIN own ON own.id = r.above WHERE own.parent IS NULL)
SELECT own.id, root, depth, root IS NULL AS cyclic FROM own LEFT JOIN t ON own.id = t.id""")
def master_chains(spark: SparkSession, d: str) -> DataFrame:
    """The topmost master of every client; one's own master is none, and of repeated rows of a client the least other one counts."""
    return graph.ancestry(read(spark, d, "clients").select(F.col("client_id").alias("id"), F.nullif("master_id", "client_id").alias("parent")))

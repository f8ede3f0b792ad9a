"""Findings of round 4: what would have failed before, and what backs the reply."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from basaltiq.operators import callgraph, communities, graph
from basaltiq.queries import relational
from basaltiq.registry import load_core
from tests.oracle import same

CORE = load_core()
SF = "/root/testdata/sf0.01"


def test_changes_of_one_moment_are_one_burst(spark, tmp_path):
    """Repeated changes of one time stand in one session, wherever sorting puts them. (Backs the reply to F2; passed before.)"""
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    rows = [(1, 5, 0, "I", at(3), "web", "a", "b", 1.0), *[(2, 5, 1, "U", at(40), "web", "a", "c", 1.0)] * 3, *[(3, 6, 0, "U", at(9), "web", "a", "b", 1.0)] * 2]
    schema = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/client_changes.parquet")
    got = sorted((r.path, r.event, r["at"], r.n) for r in CORE.builders["change_events"](spark, str(tmp_path)).collect())
    assert got == [("web/5", "create", "2024-01-04 00:00:00", 1), ("web/5", "modify", "2024-02-10 00:00:00", 3), ("web/6", "modify", "2024-01-10 00:00:00", 2)]


def _cliques(spark, n, size):
    """Edges of ``n`` cliques in both directions, and their vertices, of which the first of each stands alone."""
    pairs = [(c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(size) if i != j]
    own = [(v, float(size - 1), 0.0, v if v % size == 0 else v // size * size + 1) for v in range(n * size)]
    return spark.createDataFrame(pairs, "a long, b long, w double"), spark.createDataFrame(own, "v long, k double, loop double, c long")


def test_a_round_of_moves_writes_one_table(spark, monkeypatch):
    adjacent, own = _cliques(spark, 6, 5)
    total, written = 6 * 5 * 4.0, []
    state = communities._State(own, adjacent, total)
    monkeypatch.setattr(communities, "cut", lambda df: written.append(df.columns) or graph.cut(df))
    then = communities._settled(state, adjacent, total, 1, 0)
    assert len(written) == 1 and then.modularity > state.modularity + 0.01
    assert state.movable == 6 and all(r.to == r.v + 1 for r in state.rows.where("to is not null").collect())


def test_a_level_makes_one_pass_over_its_graph(spark, monkeypatch):
    """On the way up no graph is passed more than twice before it shrinks: the edges of all levels are few times those of the first."""
    passed, made = [], communities._State.__init__
    monkeypatch.setattr(communities._State, "__init__", lambda self, own, adjacent, total: passed.append(adjacent.count()) or made(self, own, adjacent, total))
    monkeypatch.setattr(communities, "_settled", lambda state, *_: state)
    adjacent, _ = _cliques(spark, 6, 5)
    bridges = spark.createDataFrame([(5 * k, (5 * k + 6) % 30, 1) for k in range(6)], "src long, dst long, weight long")
    edges = adjacent.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").cast("long").alias("weight")).unionByName(bridges)
    labels, q = communities.multilevel(edges)
    up = passed[: passed.index(min(passed)) + 1]
    assert up == sorted(up, reverse=True) and passed.count(132) <= 3 and q > 0.5 and labels.count() == 30


def test_what_is_seen_is_a_bit_for_each_source(spark, monkeypatch):
    """More sources than a row of bits holds; what is seen has a row for 64 of them, and edges are joined once a level, each way."""
    written = []
    monkeypatch.setattr(callgraph, "cut", lambda df: written.append(found := graph.cut(df)) or found)
    edges = spark.createDataFrame([(k, 1000) for k in range(100)] + [(1000, 2000 + k) for k in range(50)] + [(k, 2000) for k in range(3)], "src long, dst long")
    got = {r.id: r.score for r in callgraph.betweenness(edges).collect()}
    assert got == {**dict.fromkeys([*range(100), *range(2000, 2050)], 0.0), 1000: 100 * 49.0 + 97}
    seen = [df.count() for df in written if df.columns == ["id", "word", "mask"]]
    pairs = 151 + 100 + 50 + 3 + 100 * 50 - 3
    assert seen and seen == sorted(seen) and seen[-1] < pairs / 8


def test_targets_of_a_name_follow_each_other(spark, tmp_path):
    """A name's calls stand next to each other in a part, so that what is written repeats and compresses: a byte a row at most."""
    rows = CORE.builders["name_resolution_join"](spark, "/root/testdata/sf0.1")
    rows.write.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in Path(f"{tmp_path}/out").glob("*.parquet"))
    assert size < spark.read.parquet(f"{tmp_path}/out").count()


def test_names_that_are_not_broadcast_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(relational, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(relational, "CALLS_OF_A_PART", 1000)
    rows = CORE.builders["name_resolution_join"](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [name" in plan and plan.count("Exchange hashpartitioning(name") == 2
    assert same(rows, CORE.sql["name_resolution_join"], SF) > 10_000


def test_a_part_without_a_name_is_called_by_nobody(spark, tmp_path):
    spark.createDataFrame([(1, None, "b"), (2, None, "b"), (3, "n", "b"), (4, "n", "b")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(10, 1), (11, 3), (12, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert same(CORE.builders["name_resolution_join"](spark, str(tmp_path)), CORE.sql["name_resolution_join"], str(tmp_path)) == 1

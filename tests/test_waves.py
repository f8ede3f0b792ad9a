"""Topological waves, linearisation on them and shortest paths with their vertices, by brute force."""

import itertools
import random

from pyspark.sql import functions as F

from basaltiq.operators import code, extract, graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long").repartition(3)


def plain_layers(pairs, ids):
    before = {v: {a for a, b in pairs if b == v} for v in ids}
    out = {}
    while ready := [v for v in ids if v not in out and before[v] <= set(out)]:
        out |= {v: 1 + max((out[x] for x in before[v]), default=-1) for v in ready}
    return {v: out.get(v) for v in ids}


def test_layers(spark):
    rng = random.Random(2)
    acyclic = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)})
    # A cycle, what hangs behind it, a loop of one vertex, and a vertex without edges.
    pairs = [*acyclic, acyclic[0], (40, 41), (41, 42), (42, 40), (42, 43), (3, 40), (50, 50), (43, 44)]
    ids = {x for p in pairs for x in p} | {99}
    got = {r.id: r.layer for r in graph.layers(edges(spark, pairs), spark.createDataFrame([(99,)], "id long")).collect()}
    assert got == plain_layers(pairs, ids) and got[99] == 0 and got[44] is None and max(v for v in got.values() if v is not None) > 3


def test_layers_of_no_edges(spark):
    assert graph.layers(edges(spark, [(1, 2)]).where("src < 0")).count() == 0


def test_linearisation_like_the_language(spark):
    """Against Python's own classes, and None where it refuses them."""
    rng = random.Random(9)
    made, table, want = {}, [], {}
    for k in range(40):
        name, bases = f"C{k}", rng.sample(sorted(made), min(len(made), rng.randint(0, 3)))
        table.append((name, bases))
        ok = [made[b] for b in bases]
        try:
            cls = type(name, tuple(ok) or (object,), {}) if all(ok) else None
        except TypeError:
            cls = None
        made[name], want[name] = cls, cls and [c.__name__ for c in cls.__mro__ if c is not object]
        if cls is None:
            del made[name]
    table += [("X", ["Y"]), ("Y", ["X"]), ("Z", ["Y", "C0"]), ("L", ["L"]), ("E", ["outside"])]
    want |= {"X": None, "Y": None, "Z": None, "L": None, "E": ["E", "outside"]}
    got = {r["name"]: r["mro"] for r in extract.mro(spark.createDataFrame(table, "name string, bases array<string>").repartition(3)).collect()}
    assert got == want and any(v and len(v) > 4 for v in want.values())


def test_a_base_of_all_is_no_group(spark):
    """Classes of one root are tasks' rows, not one group."""
    rows = [(f"C{k}", ["object"]) for k in range(300)]
    linear = extract.mro(spark.createDataFrame(rows, "name string, bases array<string>"))
    assert {(r["name"], tuple(r["mro"])) for r in linear.collect()} == {(f"C{k}", (f"C{k}", "object")) for k in range(300)}


def plain_path(pairs, a, b, depth):
    level, seen = [(a,)], {a}
    for _ in range(depth + 1):
        if hits := [p for p in level if p[-1] == b]:
            return min(hits)
        level = [(*p, y) for p in level for x, y in pairs if x == p[-1] and y not in seen]
        seen |= {p[-1] for p in level}
    return None


def test_shortest_paths(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(22), rng.randrange(22)) for _ in range(48)})
    asked = list(itertools.product([0, 3, 7, 11], range(22))) + [(0, 777)]
    got = {(r.a, r.b): tuple(r.path) for r in graph.shortest_paths(edges(spark, pairs), spark.createDataFrame(asked, "a long, b long"), depth=6).collect()}
    want = {p: plain_path(pairs, *p, 6) for p in asked}
    assert got == {p: x for p, x in want.items() if x is not None} and max(map(len, got.values())) > 4
    few = graph.shortest_paths(edges(spark, pairs), spark.createDataFrame(asked, "a long, b long"), depth=1).collect()
    assert {(r.a, r.b) for r in few} == {p for p, x in want.items() if x is not None and len(x) <= 2} and all(r.len == len(r.path) - 1 for r in few)


def test_bracket_kinds(spark):
    rows = [(1, "x = (1]\ny = {a)\nz = [1, (2)]\nw = )\nv = ([\nu = ')' # ]")]
    got = {r.n: (r.unclosed, r.unmatched, r.mismatched) for r in code.unclosed_brackets(spark.createDataFrame(rows, "path long, text string")).collect()}
    assert got == {1: (0, 0, 1), 2: (0, 0, 1), 4: (0, 1, 0), 5: (2, 0, 0)}


def test_ancestry(spark):
    rng = random.Random(6)
    parent = {k: (None if k % 17 == 0 else rng.randrange(k)) for k in range(1, 120)} | {200: 201, 201: 202, 202: 200, 203: 200, 204: 204, 300: 999}
    links = spark.createDataFrame([*parent.items(), (5, parent[5]), (None, 3)], "id long, parent long").repartition(3)
    want = {}
    for v in set(parent) | {p for p in parent.values() if p is not None}:
        at, steps = v, 0
        while parent.get(at) is not None and steps < 200:
            at, steps = parent[at], steps + 1
        want[v] = (at, steps, False) if steps < 200 else (None, None, True)
    assert {r.id: (r.root, r.depth, r.cyclic) for r in graph.ancestry(links).collect()} == want
    assert want[203] == want[204] == (None, None, True) and want[300] == (999, 1, False)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    write = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (rounds.append(1), write(df))[1])
    chain = spark.range(1, 5001).select(F.col("id"), (F.col("id") - 1).alias("parent"))
    got = graph.ancestry(chain)
    assert got.where("root = 0 and depth = id and not cyclic").count() == 5001 and len(rounds) < 2 * 14 + 6

"""Small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from basaltiq.functions.text import glob_to_regex
from basaltiq.operators import callgraph, extract, graph, history, incremental, logs, search
from basaltiq.plans.dsl import compile_query, detect_mode, parse_boolean, safe_pattern
from basaltiq.sources import readers
from basaltiq.streaming import streams


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_transitive_callers(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (5, 4)])
    assert {r.id for r in graph.reach(graph.reverse(e), ids(spark, 4)).where("depth > 0").collect()} == {1, 2, 3, 5}
    assert max(r.len for r in graph.paths(e, ids(spark, 1), 5).collect()) == 3


def test_cycle_terminates(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1)])
    assert [(r.path, r.len) for r in graph.cycles(e, 4).collect()] == [([1, 2, 3], 3)]
    assert graph.reach(e, ids(spark, 1)).count() == 3


def test_components_and_labels(spark):
    e = edges(spark, [(1, 2), (2, 3), (4, 5)])
    assert {r.id: r.component for r in graph.weak_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert len({r.label for r in graph.label_propagation(e).collect()}) >= 2


def test_rank_sums_to_one(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert graph.page_rank(ids(spark, 1, 2, 3, 4), e, rounds=4).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_betweenness_of_a_path(spark):
    got = {r.id: r.score for r in callgraph.betweenness(edges(spark, [(1, 2), (2, 3)])).collect()}
    assert got[2] == 1.0 and got[3] == 0.0


def test_betweenness_by_enumeration(spark):
    """Against all shortest paths of a small random graph, from all vertices and from some."""
    import itertools
    import random

    r = random.Random(4)
    pairs = {(a, b) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(34)) if a != b}
    out = {v: [b for a, b in pairs if a == v] for v in range(14)}

    def shortest(s, t):
        level, seen = [[s]], {s}
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [[*p, b] for p in level for b in out[p[-1]] if b not in seen]
            seen |= {p[-1] for p in level}
        return []

    want = dict.fromkeys(range(14), 0.0)
    for s, t in itertools.permutations(range(14), 2):
        paths = shortest(s, t)
        for p in paths:
            for v in p[1:-1]:
                want[v] += 1 / len(paths)
    got = {x.id: x.score for x in callgraph.betweenness(edges(spark, sorted(pairs))).collect()}
    assert got == pytest.approx({v: want[v] for v in {x for p in pairs for x in p}}, abs=1e-5)
    assert callgraph.betweenness(edges(spark, sorted(pairs)), sources=3).count() > 0


def test_fuzzy_search_by_brute_force(spark):
    import difflib
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcde fg") for _ in range(r.randint(0, 12))) for _ in range(300)] + ["bead cafe", "BEAD CAFE", None]
    df = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = {x.id: x.score for x in search.fuzzy(df, "name", "bead cafe").collect()}
    want = {k: difflib.SequenceMatcher(None, (w or "").lower(), "bead cafe", autojunk=False).ratio() for k, w in enumerate(words)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.6}) and len(got) > 3


def test_large_groups_meet_in_parts(spark, monkeypatch):
    from basaltiq.operators import relational

    rows = [(g, i) for g in range(4) for i in range(25 if g == 0 else 6)] + [(9, 100)]
    df = spark.createDataFrame(rows, "g long, i long")
    plain = {tuple(x) for x in relational.pairs_within(df, "g", "i", least=2).collect()}
    other = df.where("g < 2").select("g", (F.col("i") + 50).alias("j"))
    tokens = {tuple(x) for x in relational.shared_tokens(df, other, "g", "i", "j", least=1).collect()}
    monkeypatch.setattr(relational, "UNIT_ROWS", 4)
    assert {tuple(x) for x in relational.pairs_within(df, "g", "i", least=2).collect()} == plain
    assert plain == {(a, b, 4) for a in range(6) for b in range(a + 1, 6)}
    assert {tuple(x) for x in relational.shared_tokens(df, other, "g", "i", "j", least=1).collect()} == tokens


def test_community_fixture(spark):
    rows, total = graph.communities(edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5)]))
    assert sorted(r["size"] for r in rows.collect())[-1] == 3 and total.first().communities >= 2 and total.first().modularity >= 0


def test_call_graph_fixture(spark):
    """login > validate > session > send, log > send: callers, entry points, blast radius with and without callers."""
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (5, 4)])
    assert {r.id for r in graph.reach(graph.reverse(e), ids(spark, 4)).where("depth > 0").collect()} == {1, 2, 3, 5}
    none = callgraph.blast_radius(graph.reach(graph.reverse(e), ids(spark, 1), depth=4)).first()
    assert (none.hit, none.score, none.risk) == (0, 0.0, "low")
    some = callgraph.blast_radius(graph.reach(graph.reverse(e), ids(spark, 4), depth=4)).first()
    assert (some.hit, some.score) == (4, pytest.approx(10 * (2 + 1 / 2 + 1 / 3), abs=1e-3))
    assert {r.id: (r.fan_in, r.fan_out) for r in graph.explore(e, ids(spark, 4), direction="in", depth=1).collect()} == {4: (2, 0), 3: (1, 1), 5: (0, 1)}


def test_timestamps_with_fractions_zones_and_no_year(spark):
    df = spark.createDataFrame([("2026-06-17T14:30:00.250+02:00 x",), ("2026/06/17 14:30:00,5Z",), ("<6>Jun 7 04:05:06 host",), ("17/Jun/2026:14:30:00 +0000",), ("no time",)], "v string")
    got = [str(r.t) for r in df.select(logs.parse_timestamp(F.col("v")).cast("string").alias("t")).collect()]
    assert got == ["2026-06-17 12:30:00.25", "2026-06-17 14:30:00.5", "2000-06-07 04:05:06", "2026-06-17 14:30:00", "None"]


def test_processes_by_breadth_first_search(spark):
    import random
    from collections import deque

    r = random.Random(6)
    pairs = sorted({(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(90)) if a != b})
    weight = {p: r.randint(1, 3) for p in pairs}
    df = spark.createDataFrame([(*p, w) for p, w in weight.items()], "src long, dst long, weight long")
    score = {v: 40 + 3 * (v % 7) for v in range(31)}
    want = {}
    for v in sorted(score, key=lambda v: (-score[v], v)):
        if score[v] < 50 or len(want) == 75:
            continue
        trace, queue = [v], deque([(v, 0)])
        while queue:
            a, d = queue.popleft()
            if d < 3:
                for b in sorted((b for x, b in pairs if x == a), key=lambda b: (-weight[a, b], b))[:2]:  # noqa: B023
                    if b not in trace:
                        trace.append(b)
                        queue.append((b, d + 1))
        if len(trace) >= 3:
            want.setdefault(">".join(map(str, trace)), v)
    got = callgraph.processes(df, spark.createDataFrame(list(score.items()), "id long, score long"), branching=2, depth=3).collect()
    assert {x.trace: x.entry for x in got} == want and all(x.steps == x.trace.count(">") + 1 for x in got)


def test_deep_and_cyclic_hierarchies(spark):
    rows = [(f"c{k:04d}", [f"c{k + 1:04d}"] if k < 1500 else []) for k in range(1501)] + [("x", ["y"]), ("y", ["x"]), ("z", ["x"]), ("o", None)]
    got = {r["name"]: r["mro"] for r in extract.mro(spark.createDataFrame(rows, "name string, bases array<string>")).collect()}
    assert len(got["c0000"]) == 1501 and got["x"] is got["y"] is got["z"] is None and got["o"] == ["o"]


def test_knowledge_patterns_by_the_plain_library(spark):
    import re

    from basaltiq.operators import code

    texts = [
        "**Concept:** an order is a set of lines\n- **Risk** - not a rule but a definition\n| `thing` | a thing of some kind |\n",
        "**Rule**: never delete a committed row\n- MUST keep the audit trail whole\nYou cannot remove the last owner, ever.\nWe chose the columnar layout for speed.\n",
        "## Decision\nUse one writer for each shard\nand many readers\n## Flow\n1. read the whole table\n2. write the result back\n\nStep 3: check that all counts agree\n",
        "**Warning** the cache is a single point of failure for logins.\nThis is fragile under heavy load, sadly.\nEach order must have exactly one customer.\n",
        "Don't call the database in a loop, please.\navoid using global mutable state.\nOur principle: keep modules small and whole\nloose-coupling single_responsibility\n**Invariant** ids never change after creation", "", None,
    ]
    want = {}
    for i, t in enumerate(texts):
        for kind, rules in code.KNOWLEDGE.items():
            for p, flags, c in rules:
                for m in re.finditer(f"(?{flags}){p}".replace(r"\z", r"\Z"), t or ""):
                    content = m[1].strip()
                    key = (i, kind, content[:100].lower())
                    if len(content) >= 15 and (key not in want or (c, content) > want[key]):
                        want[key] = (c, content)
    got = {(x.id, x.kind, x.content): x.confidence for x in code.knowledge(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert got == {(i, kind, content): c for (i, kind, _), (c, content) in want.items()}
    assert {kind for _, kind, _ in got} == set(code.KNOWLEDGE)


def test_patterns_of_queries_are_checked():
    with pytest.raises(ValueError):
        compile_query({"field": "a", "op": "regexp", "value": "(.*)+x"}, ["a"])


def test_co_change(spark):
    rows = [(c, f) for c in range(1, 5) for f in (1, 2)] + [(5, 1), (5, 3)]
    got = {(r.file_a, r.file_b): (r.score, r.risk) for r in history.co_change(spark.createDataFrame(rows, "commit long, file long"), least=1).collect()}
    assert got == {(1, 2): (0.8, "high"), (1, 3): (0.2, "low")}


def test_log_levels_and_spike(spark):
    df = spark.createDataFrame([("2026-06-17 14:30:00 WARNING x",), ("FATAL y",), ("plain",), ("2026/06/17 14:31:00 error",)], "v string")
    assert [r.level for r in df.select(logs.parse_level(F.col("v")).alias("level")).collect()] == ["WARN", "CRITICAL", "INFO", "ERROR"]
    hours = [(h, m) for h in range(23) for m in range(10)] + [(23, m) for m in range(60)]
    rows = spark.createDataFrame([(f"2026-01-01 {h:02d}:{m:02d}:00", "INFO", "x", 1) for h, m in hours], "t string, level string, message string, file long")
    got = logs.spikes(rows.withColumn("ts", F.to_timestamp_ntz("t"))).collect()
    assert len(got) == 1 and got[0].z > 3 and got[0].severity == "high"


@pytest.mark.parametrize(("query", "mode"), [("token", "keyword"), ("*.py", "glob"), ("src/**", "glob"), ("/auth.*/i", "regex"), ("a AND b", "boolean"), ("~auth~", "fuzzy"), ("title:x", "keyword")])
def test_mode_detection(query, mode):
    assert detect_mode(query)[0] == mode


def test_boolean_takes_any_number_of_operands():
    assert parse_boolean("a AND b AND NOT c") == {"and": [{"term": "a"}, {"term": "b"}, {"not": {"term": "c"}}]}


def test_query_drops_what_is_unknown(spark):
    assert compile_query({"field": "x", "op": "=", "value": 1}, ["y"]) is None
    assert compile_query({"or": []}, ["y"]) is None
    df = spark.createDataFrame([("A%",), ("b",), (None,)], "y string")
    assert df.where(compile_query({"not": {"field": "y", "op": "like", "value": "B"}}, ["y"])).count() == 1


def test_refused_pattern():
    with pytest.raises(ValueError):
        safe_pattern("(.+)+x")


def test_glob():
    import re

    assert re.search(glob_to_regex("src/*.p[yx]"), "src/a/b.py") and not re.search(glob_to_regex("src/?.py"), "src/ab.py")


def test_fuzzy_and_empty(spark):
    df = spark.createDataFrame([("authenticate",), ("authentic",), ("zzz",), (None,)], "t string")
    assert search.fuzzy(df, "t", "authenticate").count() == 2
    assert search.keyword(df.limit(0), ["t"], "x").count() == 0


def test_upsert_and_changes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k long, v string")
    assert {(r.k, r.v) for r in incremental.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d"), (None, "m")}
    assert {r.k: r.change for r in incremental.changes(old.where("k is not null"), new.where("k is not null"), ["k"]).collect()} == {1: "delete", 2: "update", 3: "insert"}


def test_change_feed_sees_renames(spark):
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, hash string"), spark.createDataFrame([("z", "1"), ("y", "3"), ("w", "4")], "path string, hash string")
    assert {r.path: r.event for r in streams.change_feed(a, b).collect()} == {"z": "rename from x", "y": "modify", "w": "create"}


SOURCE = "class A:\n    def run(self):\n        return b()\n\ndef b():\n    return 1\n\ndef a():\n    b()\n    return b()\n"


def test_symbols_and_edges(spark):
    df = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    symbols = extract.python_symbols(df)
    assert {(r["name"], r["kind"]) for r in symbols.collect()} == {("A", "class"), ("run", "method"), ("b", "function"), ("a", "function")}
    assert {(r.src, r.dst): r.weight for r in extract.call_edges(symbols).collect()} == {("m.py::a", "m.py::b"): 2.0, ("m.py::run", "m.py::b"): 1.0}


def test_linearisation(spark):
    df = spark.createDataFrame([("O", []), ("A", ["O"]), ("B", ["O"]), ("C", ["A", "B"]), ("X", ["Y"]), ("Y", ["X"])], "name string, bases array<string>")
    got = {r["name"]: r["mro"] for r in extract.mro(df).collect()}
    assert got["C"] == ["C", "A", "B", "O"] and got["X"] is None


def test_routes_and_models(spark):
    text = "@app.get('/users')\nasync def users():\n    pass\nclass User(Base):\n    __tablename__ = 'users'\n"
    df = spark.createDataFrame([("r.py", text)], "path string, text string")
    assert extract.routes(df).collect()[0].asDict() == {"path": "r.py", "method": "GET", "route": "/users", "handler": "users"}
    assert extract.orm_models(df).collect()[0].asDict() == {"path": "r.py", "model": "User", "table": "users"}


def test_ignore_last_rule_wins(spark):
    df = spark.createDataFrame([("build/a.o",), ("src/a.py",), ("src/keep.log",), ("x.log",)], "p string")
    rows = df.where(readers.ignored(F.col("p"), ["build/", "*.log", "!keep.log"])).collect()
    assert {r.p for r in rows} == {"build/a.o", "x.log"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("2026-06-17 14:31:00 ERROR refused\nplain\n")
    assert readers.walk(spark, str(tmp_path)).count() == 1
    assert [r.level for r in readers.read_logs(spark, str(tmp_path / "a")).collect()] == ["ERROR", "INFO"]
    readers.export(spark.range(3), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_sessions_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:10:00"), (1, "2026-01-01 02:00:00"), (2, "2026-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "k long, t string").select("k", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in streams.sessions(df, "ts", "30 minutes", ["k"]).collect()}
    out = []
    made = streams.sessions(streams.file_stream(spark, str(tmp_path / "in"), df.schema), "ts", "30 minutes", ["k"])
    streams.run_available(made, "", str(tmp_path / "cp"), mode="complete", each=lambda b, k: out.append({tuple(r) for r in b.collect()}))
    assert out[-1] == batch and len(batch) == 3


def test_stream_first_seen(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:01:00"), ("b", "2026-01-01 00:02:00")], "f string, t string").select("f", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    got = streams.first_seen(streams.file_stream(spark, str(tmp_path / "in"), df.schema), "ts", ["f"])
    streams.run_available(got, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.f for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]

"""Names in texts, against every pair."""

import random

from pyspark.sql import functions as F

from basaltiq.operators import patterns


def plain(texts, names):
    return {(i, n) for i, t in texts for n in names if t and n and n.strip() and n in t}


def run(spark, texts, names):
    t = spark.createDataFrame(texts, "id long, text string").repartition(3).withColumns({"name": F.lit("x"), "anchor": F.lit(1)})
    found = patterns.mentions(t, spark.createDataFrame([(n,) for n in names], "name string").withColumn("id", F.lit(1)))
    got = [(r.id, r.name) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_mentions(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    names = sorted({" ".join(word() for _ in range(rng.choice([1, 1, 1, 2, 3]))) for _ in range(150)})
    texts = [(k, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(0, 60)))) for k in range(120)]
    texts += [(200, None), (201, ""), (202, names[5]), (202, names[5]), (202, names[6]), (203, "x" * 300_000 + "@scope/left-pad"), (204, "𝒳𝒴𝒵𝒳𝒴 b")]
    names += ["@scope/left-pad", "left-pad", "nowhere", None, "", " ", "𝒴𝒵𝒳", names[0], "a b"]
    got = run(spark, texts, names)
    assert got == plain(texts, names) and (203, "left-pad") in got and (204, "𝒴𝒵𝒳") in got


def test_empty(spark):
    assert run(spark, [(1, "abc")], []) == run(spark, [], ["abc"]) == run(spark, [(1, "abc")], ["", None]) == set()


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BROADCAST_ROWS", 2)
    texts, names = [(k, f"use package-{k % 7} and pkg{k}") for k in range(40)], [f"package-{k}" for k in range(5)] + ["pkg3", "and"]
    assert run(spark, texts, names) == plain(texts, names)


def test_no_cross_join(spark):
    t, n = spark.createDataFrame([(1, "some text")], "id long, text string"), spark.createDataFrame([("text",)], "name string")
    plan = patterns.mentions(t, n)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_package_references(spark):
    packages = spark.createDataFrame([("React", "js"), ("react", "py"), ("core", None), (None, "py")], "package string, language string")
    files = spark.createDataFrame([(1, "import REACT", "py"), (2, "react.core", "js"), (3, "none", "go"), (4, "Core", None)], "id long, text string, language string")
    got = {tuple(r) for r in patterns.package_references(packages, files).collect()}
    assert got == {("React", "js", 1, "py", 0.5), ("react", "py", 2, "js", 0.5), ("core", None, 2, "js", 0.5), ("core", None, 4, None, 0.5)}

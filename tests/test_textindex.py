"""The stored full-text index against a scan, plain rules and plain filters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basaltiq.operators import search
from basaltiq.operators.textindex import TextIndex, stem

WORDS = "run runs running runner hop hopping hopped agreed feed ponies caress caresses sized failing cat cats happy sky version versions password a of".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))).title() if k % 7 else None) for k in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame(texts(60), "id long, text string").withColumn("term", F.lit("clash"))
    index = TextIndex(spark, fan_in=2)
    seen = []
    for part in range(4):
        index.add(docs.where(F.col("id") % 4 == part), "id", "text")
        seen.append(len(index.segments()))
    assert seen == [1, 2, 1, 2]  # the third one merges all
    return docs, index


def test_equals_a_scan(made):
    docs, index = made
    asked = ["running", "Cats", "of", "absent"]
    want = {r.id: r.score for r in search.bm25(docs.withColumn("text", F.coalesce("text", F.lit(""))), "id", "text", asked).collect()}
    assert {r.doc: r.score for r in index.search(asked).collect()} == pytest.approx(want) and len(want) > 10


def test_reads_only_its_buckets(made):
    _, index = made
    plan = index.postings(["password"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and "PushedFilters: [IsNotNull(term), EqualTo(term,password)]" in plan


def plain_stem(w):
    if len(w) < 4:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif re.search("[^s]s$", w):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1]
    elif re.search("[aeiouy].*(ed|ing)$", w):
        w = re.sub("(ed|ing)$", "", w)
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif re.search(r"([^aeioulsz])\1$", w):
            w = w[:-1]
    return re.sub("y$", "i", w) if re.search("[aeiouy].*y$", w) else w


def test_stems(spark, made):
    own = [*WORDS, "relating", "troubled", "falling", "hissing", "fizzed", "sing", "bed", "class", "boys", "flies", "s", ""]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in own], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == {w: plain_stem(w) for w in own} and got["hopping"] == got["hopped"] == got["hop"] == "hop"
    docs, index = made
    rows = {k for k, t in texts(60) if t and plain_stem("running") in {plain_stem(w) for w in t.lower().split()}}
    assert {r.doc for r in index.search(["Running"], stemmed=True).collect()} == rows > {r.doc for r in index.search(["running"]).collect()}


def test_prefixes(made):
    _, index = made
    assert {r.term for r in index.words_with("run").collect()} == {"run", "runs", "running", "runner"}
    assert {r.term for r in index.words_with("runni").collect()} == {"running"} and index.words_with("zz").count() == 0
    assert {r.doc for r in index.search(["ver*"]).collect()} == {k for k, t in texts(60) if t and "version" in t.lower()}
    with pytest.raises(ValueError):
        index.words_with("r")


def test_fallback(made):
    docs, index = made
    assert {r.doc for r in index.search_or_contains(docs, "id", "text", "asswor").collect()} == {k for k, t in texts(60) if t and "password" in t.lower()}
    assert all(r.score != 0.5 for r in index.search_or_contains(docs, "id", "text", "password").collect())

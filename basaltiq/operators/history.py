"""Change-history analytics over ``file_commits (commit, file)`` and commits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltiq.operators.graph import cut
from basaltiq.operators.relational import pairs_within


def band(value: Column, high: float, medium: float, *, strict: bool = False) -> Column:
    over = (lambda x: value > x) if strict else (lambda x: value >= x)
    return F.when(over(high), "high").when(over(medium), "medium").otherwise("low")


def co_change(file_commits: DataFrame, *, least: int) -> DataFrame:
    """``file_a, file_b, together, score, risk``; the score divides by the commits of more than one file."""
    file_commits = cut(file_commits)
    many = file_commits.groupBy("commit").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    pairs = pairs_within(file_commits, "commit", "file", least=least)
    score = F.col("together") / F.col("n")
    return pairs.crossJoin(F.broadcast(many)).select("file_a", "file_b", "together", F.round(score, 8).alias("score"), band(score, 0.6, 0.3).alias("risk"))


def hubs(pairs: DataFrame, *, partners: int, top: int) -> DataFrame:
    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("o"), "together").unionByName(pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("o"), "together"))
    counts = both.groupBy("file").agg(F.count("*").alias("partners"), F.round(F.avg("together"), 6).alias("mean"), F.max("together").alias("most")).where(F.col("partners") >= partners)
    # Apart from the counts, so that the group limit leaves a few partners of each file before the shuffle.
    ranked = both.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("together"), "o"))).where(F.col("k") <= top)
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("o").cast("string").alias("o")))), lambda x: x["o"]), ",")
    return counts.join(ranked.groupBy("file").agg(first.alias("top")), "file")


def churn(file_commits: DataFrame, k: int) -> DataFrame:
    per = file_commits.groupBy("file").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "file").limit(k)
    return per.withColumn("risk", band(F.col("commits"), 150, 50, strict=True))


def magnets(file_commits: DataFrame, commits: DataFrame, pattern: str, k: int) -> DataFrame:
    fixes = commits.where(F.lower("message").rlike(pattern)).select("commit")
    return file_commits.join(fixes, "commit", "left_semi").groupBy("file").agg(F.count("*").alias("fixes")).orderBy(F.desc("fixes"), "file").limit(k)


def velocity(commits: DataFrame) -> DataFrame:
    """Mean of each author's last three active months against the first three."""
    per = commits.groupBy("author", F.date_trunc("month", "at").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("author")
    ranked = per.withColumn("a", F.row_number().over(w.orderBy("month"))).withColumn("z", F.row_number().over(w.orderBy(F.desc("month"))))
    means = ranked.groupBy("author").agg(F.avg(F.when(F.col("a") <= 3, F.col("n"))).alias("first"), F.avg(F.when(F.col("z") <= 3, F.col("n"))).alias("last"))
    return means.select("author", F.when(F.col("last") > F.col("first") * 1.2, "accelerating").when(F.col("last") < F.col("first") * 0.8, "decelerating").otherwise("stable").alias("trend"))


def bus_factor(commits: DataFrame, k: int = 10) -> DataFrame:
    per = commits.groupBy("author").agg(F.count("*").alias("commits"))
    share = 100.0 * F.col("commits") / F.col("total")
    out = per.crossJoin(F.broadcast(per.agg(F.sum("commits").alias("total")))).select("author", "commits", F.round(share, 4).alias("share"), band(share, 60, 40, strict=True).alias("risk"))
    return out.orderBy(F.desc("commits"), "author").limit(k)


def crises(commits: DataFrame, pattern: str) -> DataFrame:
    n = F.count_if(F.lower("message").rlike(pattern))
    return commits.agg(n.alias("crises")).withColumn("risk", band(F.col("crises"), 50, 20, strict=True))


def fragility(files: DataFrame, now: DataFrame) -> DataFrame:
    """``files (file, churn, complexity, coupling, together, at)``; weights .25 .20 .20 .20 .15."""
    part = lambda x, most: F.least(x / F.lit(most), F.lit(1.0))
    days = F.datediff("now", "at")
    x = 0.25 * part(F.col("churn"), 100.0) + 0.20 * part(F.col("complexity"), 50.0) + 0.20 * part(F.col("coupling"), 50.0) + 0.20 * part(F.col("together"), 100.0) + 0.15 * part(days, 365.0)
    scored = files.crossJoin(F.broadcast(now)).select("file", F.round(100 * x, 4).alias("score"))
    return scored.withColumn("band", F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 50, "high").when(F.col("score") >= 30, "medium").otherwise("low"))


STALENESS = ((0, "current"), (3, "fresh"), (7, "aging"), (30, "stale"), (90, "old"))


def staleness(commits: DataFrame) -> DataFrame:
    newest = commits.agg(F.max("at").alias("now"))
    per = commits.groupBy("repo").agg(F.max("at").alias("at")).crossJoin(F.broadcast(newest))
    days = F.datediff("now", "at")
    level = reduce(lambda acc, x: F.when(days <= x[0], x[1]).otherwise(acc), reversed(STALENESS), F.lit("abandoned"))
    return per.select("repo", level.alias("level"))


SECRETS = (r"AKIA[0-9A-Z]{16}", r"(?:token|password) ?= ?\"?[0-9a-f]{8,}")


def secret_scan(docs: DataFrame) -> DataFrame:
    n = reduce(lambda a, b: a + b, [F.regexp_count("text", F.lit(p)) for p in SECRETS])
    return docs.select("doc_id", n.cast("long").alias("findings")).where("findings > 0")

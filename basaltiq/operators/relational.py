"""Relational operators on any table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def severity_at_least(df: DataFrame, column: str, order: dict[str, int], least: int, default: int = 1) -> DataFrame:
    rank = F.lit(default)
    for name, value in order.items():
        rank = F.when(F.col(column) == name, value).otherwise(rank)
    return df.where(rank >= least)


def keyset_page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """Rows after a key, one more than the page, which tells whether there is a next one."""
    return df.where(F.col(key) > after).orderBy(key).limit(size + 1)


#: Rows that a task pairs: its pairs are held for counting, so tasks follow the rows, not the bytes shuffled.
TASK_ROWS = 100_000
#: Rows of a group that meet each other in one unit of work.
UNIT_ROWS = 1000
#: Rows of a table of large groups that may be broadcast.
MOST_LARGE = 1_000_000


def _split(df: DataFrame, group: str) -> DataFrame:
    """``df`` with ``_n``, the parts of its group, and ``_k``, the row's part; only groups over ``UNIT_ROWS`` have more than one."""
    large = df.groupBy(group).agg(F.ceil(F.count("*") / UNIT_ROWS).cast("int").alias("_n")).where("_n > 1")
    side = F.broadcast(large) if large.count() <= MOST_LARGE else large
    rest = [c for c in df.columns if c != group]
    found = df.join(side, group, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return found.withColumn("_k", F.pmod(F.xxhash64(*rest), F.col("_n")).cast("int"))


def pairs_within(df: DataFrame, group: str, item: str, *, least: int = 1) -> DataFrame:
    """``<item>_a, <item>_b, together``: pairs of items in common groups; ``df`` is a written table of distinct (group, item).

    Items in fewer than ``least`` groups leave first. A large group is cut into parts, and each pair of parts is a unit
    of its own, so that no task squares a group.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    if least > 1:
        often = df.groupBy(item).agg(F.count("*").alias("_often")).where(F.col("_often") >= least).select(item)
        df = df.join(often, item).select(group, item)
    own = _split(df.select(group, item), group)
    to = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = own.select(group, F.col(item).alias(f"{item}_a"), F.col("_k").alias("_i"), to.alias("_j"))
    b = own.select(group, F.col(item).alias(f"{item}_b"), to.alias("_i"), F.col("_k").alias("_j"))
    unit = [group, "_i", "_j"]
    pairs = a.repartition(parts, *unit).join(b.repartition(parts, *unit), unit).where(F.col(f"{item}_a") < F.col(f"{item}_b"))
    return pairs.groupBy(f"{item}_a", f"{item}_b").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def shared_tokens(left: DataFrame, right: DataFrame, token: str, a: str, b: str, *, least: int) -> DataFrame:
    """``a, b, shared``: pairs over two tables of distinct (token, a) and (token, b).

    Where the right table is small it meets the left rows where they stand: if these are dealt by ``a``, pairs are counted
    without a shuffle. Else the left rows of a frequent token are cut into parts."""
    if right.count() <= MOST_LARGE:
        lists = right.groupBy(token).agg(F.collect_list(F.struct(b)).alias("_b"))
        pairs = left.join(F.broadcast(lists), token).select(a, F.explode("_b").alias("_b")).select(a, f"_b.{b}")
    else:
        own = _split(left.select(token, a), token).drop("_n")
        parts = own.select(token, "_k").distinct()
        pairs = own.join(right.join(parts, token), [token, "_k"])
    return pairs.groupBy(a, b).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def within(df: DataFrame, key: str, ts: str, ident: str, *, minutes: int) -> DataFrame:
    """``earlier, later``: rows of one key at most ``minutes`` apart. Joined on the time slot and its next one, so work
    grows with true neighbours and not with the square of a key's rows."""
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (60 * minutes))
    a = df.select(key, F.col(ts).alias("t1"), F.col(ident).alias("earlier"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    b = df.select(key, F.col(ts).alias("t2"), F.col(ident).alias("later"), slot.alias("slot"))
    return a.join(b, [key, "slot"]).where((F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))).select("earlier", "later")


def histogram(df: DataFrame, column: str, edges: list[tuple[str, int]], rest: str) -> DataFrame:
    low, made = None, []
    for name, high in edges:
        inside = F.col(column) < high if low is None else (F.col(column) >= low) & (F.col(column) < high)
        made.append(F.count_if(inside).alias(name))
        low = high
    return df.agg(*made, F.count_if(F.col(column) >= low).alias(rest))


def usage(df: DataFrame, key: str, size: str) -> DataFrame:
    per = df.groupBy(key).agg(F.sum(size).alias("size"))
    total = per.agg(F.sum("size").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(key, "size", F.round(100.0 * F.col("size") / F.col("total"), 4).alias("percent"))


def directory_rollup(files: DataFrame) -> DataFrame:
    """``path, entries, size`` for each directory above ``files (path, size)``; paths begin with ``/``."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(above).alias("p"), "size").groupBy(F.when(F.col("p") == "", "/").otherwise(F.col("p")).alias("path")).agg(F.count("*").alias("entries"), F.round(F.sum("size"), 2).alias("size"))


def compliance(findings: DataFrame, key: str) -> DataFrame:
    n = {s: F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")}
    counted = findings.groupBy(key).agg(*(c.alias(s) for s, c in n.items()))
    score = 100 - 15 * F.col("critical") - 10 * F.col("high") - 5 * F.col("medium") - 2 * F.col("low")
    return counted.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n, lo, hi, mean`` of numeric columns, in one pass."""
    made = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.round(F.avg(c), 4).alias("mean")).alias(c) for c in columns])
    return made.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.column_name", "x.s.n", "x.s.lo", "x.s.hi", "x.s.mean")

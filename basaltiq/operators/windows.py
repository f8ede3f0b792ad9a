"""Order-dependent operators: sessions, lineage, lines, chunks and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, key: str, ts: str, ident: str, *, minutes: int) -> DataFrame:
    """``ident, key, session, depth``: a gap of more than ``minutes`` begins a session; both sorts share one shuffle."""
    w = Window.partitionBy(key).orderBy(ts, ident)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    fresh = df.withColumn("_fresh", F.when(gap <= minutes * 60_000_000, 0).otherwise(1))
    numbered = fresh.withColumn("session", F.sum("_fresh").over(w))
    depth = F.row_number().over(Window.partitionBy(key, "session").orderBy(ts, ident)).cast("long") - 1
    return numbered.select(ident, key, "session", depth.alias("depth"))


def lineage(df: DataFrame, keys: list[str], order: list[str], ident: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.array_join(F.collect_list(F.col(ident).cast("string")).over(w.rowsBetween(Window.unboundedPreceding, -1)), ",")
    return df.select(ident, (F.row_number().over(w).cast("long") - 1).alias("depth"), before.alias("lineage"))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n, line``, numbered from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n0", "line")).select("doc_id", (F.col("n0") + 1).cast("long").alias("n"), "line")


def chunks(rows: DataFrame, boundary: str, *, least: int) -> DataFrame:
    """Runs of lines that begin at a boundary, with more than ``least`` characters."""
    w = Window.partitionBy("doc_id").orderBy("n")
    cut = rows.withColumn("chunk", F.sum(F.when(F.col("line").rlike(boundary), 1).otherwise(0)).over(w))
    per = cut.groupBy("doc_id", "chunk").agg((F.sum(F.length("line") + 1) - 1).alias("n_chars"), F.count("*").alias("n_lines"))
    return per.where(F.col("n_chars") > least)


def renumber(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order with ``position`` and a relevance that falls by a twentieth each; the limit is taken
    before the window, so no task sees more than ``limit`` rows."""
    first = df.orderBy(*order).limit(limit)
    ranked = first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.withColumn("relevance", F.round(F.greatest(F.lit(0.0), 1 - 0.05 * (F.col("position") - 1)), 4))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Spark keeps at most k rows of a group on the map side (WindowGroupLimit)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")

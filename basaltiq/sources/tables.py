"""Table access and the bindings of catalog concepts to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commit, file``: the parts of each order. Rows are dealt before repeats are dropped: few repeat, and a task that reads a file
    of short rows would hold all of them."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "commit", "file").distinct()


def call_edges(spark: SparkSession, sf_dir: str, over: float = 40.0) -> DataFrame:
    """``src, dst, weight``: successive parts of an order among lines of more than ``over`` pieces."""
    base = read(spark, sf_dir, "lineitem").where(F.col("l_quantity") > over).groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ln"))
    w = Window.partitionBy("l_orderkey").orderBy("ln", "l_partkey")
    following = base.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    return following.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def call_edges_sql(over: float = 40.0) -> str:
    """The same as common table expressions, for oracles."""
    return f"""base AS (SELECT l_orderkey o, l_partkey p, min(l_linenumber) ln FROM lineitem WHERE l_quantity > {over} GROUP BY 1, 2),
nxt AS (SELECT p AS src, lead(p) OVER (PARTITION BY o ORDER BY ln, p) AS dst FROM base),
edges AS (SELECT src, dst, count(*) AS weight FROM nxt WHERE dst IS NOT NULL GROUP BY 1, 2)"""


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: ``ts, level, message, file``."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    return read(spark, sf_dir, "events").select("event_id", "ts", level.alias("level"), F.concat_ws(" ", "event_type", "props").alias("message"), (F.col("user_id") % 10).alias("file"))


LOG_SQL = """logs AS (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
  concat_ws(' ', event_type, props) AS message, user_id % 10 AS file FROM events)"""

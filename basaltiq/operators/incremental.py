"""Upserts, change logs and compaction as pure functions over (old, new)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of old ones with the same key. Null keys match, as in a merge on ``<=>``."""
    tagged = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    newest = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_v").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], weight: str) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.sum(weight).alias(weight))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with ``change``: insert, update, delete or same, by SHA-256 of the other columns."""
    digest = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in keys])), 256).alias(name))
    both = digest(old, "h_old").join(digest(new, "h_new"), keys, "full")
    kind = F.when(F.col("h_old").isNull(), "insert").when(F.col("h_new").isNull(), "delete").when(F.col("h_old") != F.col("h_new"), "update").otherwise("same")
    return both.select(*keys, kind.alias("change"))


def without_orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def manifest_delta(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, action`` for files that differ from the manifest by hash: what an incremental run has to read or drop."""
    return changes(manifest, listing, ["path"]).where("change <> 'same'").withColumnRenamed("change", "action")

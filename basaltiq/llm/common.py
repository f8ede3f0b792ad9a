"""Shared helpers: table access, the cluster's shared folder, and lineage cuts through written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a (hash, id) table that may be broadcast: 1 M rows of two longs are about 40 MB in a hashed relation.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset only a local session, whose
    executors see the driver's folders, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="basaltiq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, columns stay compressed, and a lost executor loses nothing.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_by_file(manifest: DataFrame) -> DataFrame:
    """As many partitions as the manifest has files, a file each. The number is given, so that adaptive execution does not
    join them by the manifest's few bytes; ranges of that number are even, where hashes would leave gaps."""
    return manifest.repartitionByRange(max(1, manifest.count()), "path")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is much faster than ``translate`` and agrees with it on ASCII text."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def let(value: Column, body) -> Column:
    """Bind ``value`` once: a lambda variable is evaluated once, an inlined expression for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sources_of(docs: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns; ones that the input lacks are null."""
    return docs.select(*[docs[c] if c in docs.columns else F.lit(None).cast("string").alias(c) for c in needed])

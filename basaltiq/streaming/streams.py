"""Structured Streaming forms: file streams, windows with watermarks, deduplication and snapshot change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from basaltiq.operators.incremental import changes


def file_stream(spark: SparkSession, path: str, schema: StructType, *, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    return event_time(df, ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    return event_time(df, ts, late).groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    return event_time(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(df: DataFrame, ts: str, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    """Each fingerprint once within the watermark."""
    return event_time(df, ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, out: str, checkpoint: str, *, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Take in what is there, then stop: an incremental run. ``each`` gets the micro-batches in place of the sink."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return query


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, event``: create, modify, delete, and rename where one content left a path and came to another."""
    found = changes(before.select("path", "hash"), after.select("path", "hash"), ["path"]).where("change <> 'same'")
    names = {"insert": "create", "update": "modify", "delete": "delete"}
    event = F.coalesce(*[F.when(F.col("change") == k, F.lit(v)) for k, v in names.items()])
    gone = found.where("change = 'delete'").join(before, "path").select("hash", F.col("path").alias("old"))
    came = found.where("change = 'insert'").join(after, "path").select("hash", "path")
    moved = came.groupBy("hash").agg(F.min("path").alias("path")).join(gone.groupBy("hash").agg(F.min("old").alias("old")), "hash")
    rest = found.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old").alias("path")), "path", "left_anti")
    return rest.select("path", event.alias("event")).unionByName(moved.select("path", F.concat(F.lit("rename from "), "old").alias("event")))

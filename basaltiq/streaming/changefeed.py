"""Change events of files: bursts on a path become one event, a delete and a create of one content become a rename.

Events ``path, kind (create, modify, delete), hash, ts, seq`` arrive in any order. A path's events with no more than ``quiet``
between them are a burst; its first and last event, by ``(ts, seq, kind, hash)``, say what happened:

    first create, last delete: nothing        last delete: delete        first create: create        else: modify

A delete and a create of one hash no more than ``within`` apart are a rename where the hash has no other delete or create
near; where it has some, one delete and one create of one file name are. Other deletes and creates stand as they are.

Both steps are session windows whose state is a count and an extreme for each open session, however many events a path or a
hash has; events of one task are merged before they are shuffled. The same functions take tables and streams, so a stream
gives what the batch gives as long as no event is later than ``late``. ``follow`` runs both steps on what is new in a folder
of events. Open sessions close when the watermark passes them: ``closing`` makes the clock rows that close all of them.

Defined results. Events without path, kind or time are left out. A null ``seq`` or ``hash`` sorts first; a null or empty hash
is never renamed. Repeated events change nothing but ``n``. Other columns are ignored. No events, no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.streaming.streams import run_available

EVENTS = "path string, kind string, hash string, ts timestamp, seq long"
BURSTS = "path string, event string, hash string, at timestamp, n long"
MOVES = "old string, old_at timestamp, new string, new_at timestamp"
CLOCK = "clock"


def bursts(events: DataFrame, *, quiet: str = "1 second", late: str = "1 minute") -> DataFrame:
    """``path, event, hash, at, n``: a row for each burst; ``at`` is the time of its last event. Clock rows pass through."""
    known = events.where(F.col("ts").isNotNull() & F.col("kind").isNotNull() & (F.col("path").isNotNull() | (F.col("kind") == CLOCK)))
    timed = known.select("path", F.col("ts").cast("timestamp").alias("ts"), F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "kind", "hash").alias("e"))
    made = timed.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet)).agg(F.min("e").alias("first"), F.max("e").alias("last"), F.count("*").alias("n"))
    first, last = F.col("first.kind"), F.col("last.kind")
    event = F.when(last == CLOCK, last).when((last == "delete") & (first == "create"), None).when(last == "delete", last).when(first == "create", first).otherwise("modify")
    # The filter asks for what is aggregated, so it stays above the watermark, which clock rows have to move.
    return made.select("path", event.alias("event"), F.col("last.hash").alias("hash"), F.col("last.ts").alias("at"), "n").where("event is not null")


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def moves(found: DataFrame, *, within: str = "2 seconds", late: str = "0 seconds") -> DataFrame:
    """``old, old_at, new, new_at`` from bursts: unambiguous pairs of a delete and a create, some found by both of their keys."""
    ends = found.where(F.col("event").isin("delete", "create") & (F.col("hash") != "") | (F.col("event") == CLOCK)).withWatermark("at", late)
    keys = F.when(F.col("event") == CLOCK, F.array(F.lit(None).cast("string"))).otherwise(F.array("hash", F.concat("hash", F.lit("/"), _file_name(F.col("path")))))
    end = F.struct("path", "at")
    deleted, created = F.when(F.col("event") == "delete", end), F.when(F.col("event") == "create", end)
    made = ends.select("path", "event", "at", F.explode(keys).alias("key")).groupBy("key", F.session_window("at", within)).agg(
        F.count(deleted).alias("n_deleted"), F.count(created).alias("n_created"), F.min(deleted).alias("old"), F.min(created).alias("new"))
    pair = made.where("n_deleted = 1 and n_created = 1 and old.path <> new.path")
    return pair.select(F.col("old.path").alias("old"), F.col("old.at").alias("old_at"), F.col("new.path").alias("new"), F.col("new.at").alias("new_at"))


def feed(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``path, event, at, hash, was, n``: the bursts, with renames in place of the deletes and creates that they explain."""
    side = F.explode(F.array(F.struct(F.col("old").alias("path"), F.col("old_at").alias("at"), F.lit(None).cast("string").alias("was"), F.lit(True).alias("gone")), F.struct(F.col("new").alias("path"), F.col("new_at").alias("at"), F.col("old").alias("was"), F.lit(False).alias("gone"))))
    sides = pairs.distinct().select(side.alias("s")).select("s.*")
    both = found.where(F.col("event") != CLOCK).join(sides, ["path", "at"], "left").where(~F.coalesce("gone", F.lit(False)))
    return both.select("path", F.when(F.col("was").isNotNull(), "rename").otherwise(F.col("event")).alias("event"), "at", "hash", "was", "n")


def follow(spark: SparkSession, source: str, base: str, *, quiet: str = "1 second", within: str = "2 seconds", late: str = "1 minute") -> None:
    """Take in the files of events that ``source`` has gained since the last call on ``base``, which holds results and checkpoints.

    A call's bursts end after those of the calls before, so the second stream, which takes all of them at once, needs no slack."""
    run_available(bursts(spark.readStream.schema(EVENTS).parquet(source), quiet=quiet, late=late), f"{base}/bursts", f"{base}/bursts-log")
    run_available(moves(spark.readStream.schema(BURSTS).parquet(f"{base}/bursts"), within=within), f"{base}/moves", f"{base}/moves-log")


def followed(spark: SparkSession, base: str) -> DataFrame:
    """The feed of all closed bursts under ``base``. A burst whose rename is still open shows as delete or create."""
    return feed(spark.read.schema(BURSTS).parquet(f"{base}/bursts"), spark.read.schema(MOVES).parquet(f"{base}/moves"))


def closing(spark: SparkSession, after: dt.datetime, span: dt.timedelta) -> DataFrame:
    """Clock rows that close all sessions: ``span`` must exceed ``quiet``, ``within`` and ``late``. The second clock sends the first
    one through to the renames. Two rows."""
    rows = [(None, CLOCK, None, after + k * span, None) for k in (2, 4)]
    return spark.createDataFrame(rows, EVENTS)


def sync_actions(changes: DataFrame, manifest: DataFrame, listing: DataFrame, *, since: dt.datetime | None, kept_from: dt.datetime | None = None) -> tuple[DataFrame, str | None]:
    """``path, action (read, drop)`` and, where everything has to be read again, why.

    From the feed: a path's last event after ``since`` decides; a rename drops the path that it left, unless that came back later.
    Without a position, or when the feed no longer reaches back to it, all of ``listing (path)`` is read and what ``manifest
    (path)`` has beyond it is dropped."""
    reason = "no earlier position" if since is None else f"changes are kept from {kept_from} only" if kept_from is not None and since < kept_from else None
    if reason:
        gone = manifest.select("path").distinct().join(listing.select("path"), "path", "left_anti")
        return listing.select("path").distinct().withColumn("action", F.lit("read")).unionByName(gone.withColumn("action", F.lit("drop"))), reason
    fresh = changes.where(F.col("at") > F.lit(since))
    own = F.struct("path", F.when(F.col("event") == "delete", "drop").otherwise("read").alias("action"))
    left = F.when(F.col("was").isNotNull(), F.struct(F.col("was").alias("path"), F.lit("drop").alias("action")))
    steps = fresh.select("at", F.explode(F.array_compact(F.array(own, left))).alias("s")).select("s.path", "s.action", "at")
    # Of equal times the greater word wins: what may be there is read.
    return steps.groupBy("path").agg(F.max_by("action", F.struct("at", "action")).alias("action")), None

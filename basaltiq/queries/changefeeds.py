"""Queries of change events (Z1, Z3): client changes as events of files, replayed in order of arrival."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators.graph import shared_folder
from basaltiq.registry import CORE
from basaltiq.sources.tables import read
from basaltiq.streaming import changefeed

Q = CORE.query

QUIET, WITHIN, LATE = "2 days", "3 days", "5 days"
STARTS, FIRST_DAY, DAYS = 3, 19723, 152
SINCE = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)

#: A gap equal to the width still belongs to a session.
FEED_SQL = """e AS (SELECT source || '/' || client_id AS path, CASE op WHEN 'I' THEN 'create' WHEN 'D' THEN 'delete' ELSE 'modify' END AS kind, concat_ws('-', segment, city) AS hash, valid_at AS ts, coalesce(seq, -1) AS seq
  FROM client_changes WHERE source IS NOT NULL AND client_id IS NOT NULL AND valid_at IS NOT NULL),
g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
a AS (SELECT path, session, arg_min(kind, (ts, seq, kind, hash)) AS k0, arg_max(kind, (ts, seq, kind, hash)) AS k1, arg_max(hash, (ts, seq, kind, hash)) AS hash, max(ts) AS ts_, count(*) AS n FROM s GROUP BY 1, 2),
b AS (SELECT path, CASE WHEN k1 = 'delete' THEN 'delete' WHEN k0 = 'create' THEN 'create' ELSE 'modify' END AS event, hash, ts_ AS ts, n FROM a WHERE NOT (k0 = 'create' AND k1 = 'delete')),
x AS (SELECT *, unnest([hash, hash || '/' || split_part(path, '/', 2)]) AS key FROM b WHERE event <> 'modify' AND hash <> ''),
y AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY key ORDER BY ts) + INTERVAL 3 DAY THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM y),
p AS (SELECT max(CASE WHEN event = 'delete' THEN path END) AS old, max(CASE WHEN event = 'delete' THEN ts END) AS old_ts, max(CASE WHEN event = 'create' THEN path END) AS new, max(CASE WHEN event = 'create' THEN ts END) AS new_ts
  FROM z GROUP BY key, session HAVING count(*) = 2 AND count(*) FILTER (event = 'delete') = 1),
m AS (SELECT DISTINCT * FROM p WHERE old <> new),
f AS (SELECT path, CASE WHEN m.old IS NULL THEN event ELSE 'rename' END AS event, ts, hash, m.old AS was, n FROM b LEFT JOIN m ON m.new = path AND m.new_ts = ts WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.old = path AND o.old_ts = ts))"""


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """The feed after three starts, each with the changes that arrived by then, 0 to 3 days after they happened."""
    base = f"{shared_folder(spark)}/changefeed-{uuid.uuid4().hex}"
    rows = read(spark, d, "client_changes").where("client_id is not null and valid_at is not null")
    day = F.unix_date(F.col("valid_at").cast("date")) + F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")) % 4, F.lit(0))
    start = F.least(F.lit(STARTS - 1), F.greatest(F.lit(0), F.floor((day - FIRST_DAY) * STARTS / DAYS))).cast("int")
    kind = F.when(F.col("op") == "I", "create").when(F.col("op") == "D", "delete").otherwise("modify")
    # Times without a zone are taken for UTC, whatever the session's zone.
    at = F.to_timestamp(F.concat(F.date_format("valid_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z")))
    events = rows.select(F.concat("source", F.lit("/"), F.col("client_id").cast("string")).alias("path"), kind.alias("kind"), F.concat_ws("-", "segment", "city").alias("hash"), at.alias("ts"), F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), start.alias("start"))
    staged = f"{base}/staged"
    events.write.partitionBy("start").parquet(staged)
    for k in range(STARTS):
        new = spark.read.schema(changefeed.EVENTS + ", start int").parquet(staged).where(F.col("start") == k).drop("start")
        if k == STARTS - 1:
            # The clock follows the events: sessions after a fixed day would stay open, and their events be lost.
            newest = spark.read.schema(changefeed.EVENTS).parquet(staged).agg(F.max(F.unix_micros("ts")).alias("m")).first().m or 0
            last = dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + max(dt.timedelta(microseconds=newest), dt.timedelta(days=FIRST_DAY + DAYS + 366))
            new = new.unionByName(changefeed.closing(spark, last, dt.timedelta(days=30)))
        new.write.mode("append").parquet(f"{base}/events")
        changefeed.follow(spark, f"{base}/events", base, quiet=QUIET, within=WITHIN, late=LATE)
    return changefeed.followed(spark, base)


@Q(f"""WITH {FEED_SQL} SELECT path, event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", hash, was, n FROM f""")
def change_events(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d).withColumn("at", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))


@Q(f"""WITH {FEED_SQL}, t AS (SELECT path, CASE event WHEN 'delete' THEN 'drop' ELSE 'read' END AS action, ts FROM f WHERE ts > TIMESTAMP '2024-03-01' UNION ALL SELECT was, 'drop', ts FROM f WHERE ts > TIMESTAMP '2024-03-01' AND was IS NOT NULL)
SELECT path, arg_max(action, (ts, action)) AS action FROM t GROUP BY 1""")
def sync_since(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "path string")
    return changefeed.sync_actions(_replayed(spark, d), none, none, since=SINCE)[0]

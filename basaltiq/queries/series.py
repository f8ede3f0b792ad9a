"""Windows, logs and change history (W, L, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltiq.operators import history, logs, windows
from basaltiq.registry import CORE
from basaltiq.sources.tables import LOG_SQL, file_commits, log_events, read

Q = CORE.query


# ------------------------------------------------------------------ windows


def _sessions_sql(gap: str) -> str:
    return f"""WITH x AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM x)
SELECT event_id, user_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1 AS depth FROM y"""


@Q(_sessions_sql("12 HOUR"))
def sessions_12h(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(read(spark, d, "events"), "user_id", "ts", "event_id", minutes=720)


@Q(_sessions_sql("30 MINUTE"))
def sessions_30min(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(read(spark, d, "events"), "user_id", "ts", "event_id", minutes=30)


@Q("""SELECT event_id, depth, lineage FROM (SELECT event_id, row_number() OVER w - 1 AS depth, coalesce(string_agg(event_id::VARCHAR, ',') OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lineage
FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id))""")
def hour_sessions_with_lineage(spark: SparkSession, d: str) -> DataFrame:
    return windows.lineage(read(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts")), ["user_id", "hour"], ["ts", "event_id"], "event_id")


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


@Q(f"WITH {LINES} SELECT doc_id, n, coalesce(lag(length(line)) OVER w, -1) AS before, coalesce(lead(length(line)) OVER w, -1) AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n) QUALIFY regexp_matches(line, '[0-9]{{4}}')")
def match_context(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("n")
    near = windows.lines(read(spark, d, "documents")).select("doc_id", "n", "line", F.coalesce(F.lag(F.length("line")).over(w), F.lit(-1)).alias("before"), F.coalesce(F.lead(F.length("line")).over(w), F.lit(-1)).alias("after"))
    return near.where(F.col("line").rlike("[0-9]{4}")).drop("line")


@Q(f"WITH {LINES} SELECT doc_id, n, max(CASE WHEN contains(line, ' | ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS near_table FROM lines QUALIFY starts_with(line, 'The')")
def query_near_loop(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(0, 9)
    got = windows.lines(read(spark, d, "documents")).select("doc_id", "n", "line", F.max(F.when(F.col("line").contains(" | "), 1).otherwise(0)).over(w).alias("near_table"))
    return got.where(F.col("line").startswith("The")).drop("line")


@Q(f"WITH {LINES} SELECT doc_id, n, last_value(CASE WHEN length(line) < 20 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM lines")
def running_section(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the last short line before them as heading."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return windows.lines(read(spark, d, "documents")).select("doc_id", "n", F.last(F.when(F.length("line") < 20, F.col("line")), ignorenulls=True).over(w).alias("heading"))


@Q(f"""WITH {LINES}, b AS (SELECT doc_id, n, line, sum(CASE WHEN regexp_matches(line, '^[A-Z].*[.]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lines)
SELECT doc_id, k::BIGINT AS chunk, sum(length(line) + 1)::BIGINT - 1 AS n_chars, count(*) AS n_lines FROM b GROUP BY 1, 2 HAVING sum(length(line) + 1) - 1 > 20""")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return windows.chunks(windows.lines(read(spark, d, "documents")), r"^[A-Z].*[.]$", least=20)


@Q("""WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mo, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY mo) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY mo DESC) AS z FROM m),
s AS (SELECT o_custkey, avg(n) FILTER (WHERE a <= 3) AS first, avg(n) FILTER (WHERE z <= 3) AS last FROM r GROUP BY 1)
SELECT o_custkey AS author, CASE WHEN last > first * 1.2 THEN 'accelerating' WHEN last < first * 0.8 THEN 'decelerating' ELSE 'stable' END AS trend FROM s""")
def velocity_trend(spark: SparkSession, d: str) -> DataFrame:
    return history.velocity(read(spark, d, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at")))


@Q("""SELECT o_custkey AS author, count(*) AS commits, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, CASE WHEN 100.0 * count(*) / sum(count(*)) OVER () > 60 THEN 'high' WHEN 100.0 * count(*) / sum(count(*)) OVER () > 40 THEN 'medium' ELSE 'low' END AS risk FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return history.bus_factor(read(spark, d, "orders").select(F.col("o_custkey").alias("author")))


@Q("SELECT doc_id, r AS position, round(greatest(0, 1 - 0.05 * (r - 1)), 4) AS relevance FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 30")
def rank_renumber(spark: SparkSession, d: str) -> DataFrame:
    return windows.renumber(read(spark, d, "documents"), [F.desc("n_chars"), F.col("doc_id")], 30).select("doc_id", "position", "relevance")


@Q("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def group_top_k(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_per_group(read(spark, d, "documents"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 5).select("lang", "doc_id")


@Q("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))))")
def first_seen_dedup(spark: SparkSession, d: str) -> DataFrame:
    # A minimum by fingerprint combines on the map side; a window would gather each group.
    print_ = F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " "))), 256)
    return read(spark, d, "documents").groupBy(print_.alias("p")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


# ------------------------------------------------------------------ logs


@Q(f"WITH {LOG_SQL} SELECT level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM logs GROUP BY 1")
def level_distribution(spark: SparkSession, d: str) -> DataFrame:
    return logs.levels(log_events(spark, d))


@Q("SELECT event_id, CASE upper(regexp_extract(event_type, '(?i)(error|purchase|signup)', 1)) WHEN 'ERROR' THEN 'ERROR' WHEN 'PURCHASE' THEN 'WARN' WHEN 'SIGNUP' THEN 'CRITICAL' ELSE 'INFO' END AS level FROM events")
def level_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.replace(F.replace("event_type", F.lit("purchase"), F.lit("WARNING: slow")), F.lit("signup"), F.lit("fatal fault")), F.lit("error"), F.lit("[ERROR] x"))
    return read(spark, d, "events").select("event_id", logs.parse_level(text).alias("level"))


@Q("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN strftime(ts, '2000-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    style, at = F.pmod("event_id", F.lit(5)), lambda form: F.date_format("ts", form)
    line = F.when(style == 0, F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" [INFO] x"))).when(style == 1, F.concat(F.lit("at "), at("yyyy/MM/dd HH:mm:ss"), F.lit(" x"))).when(style == 2, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z x")))
    line = line.when(style == 3, F.concat(F.date_format(F.expr("ts + INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit(",250+0200 x"))).otherwise(F.concat(F.lit("<6>"), at("MMM d HH:mm:ss"), F.lit(" host x")))
    return read(spark, d, "events").select("event_id", F.date_format(logs.parse_timestamp(line), "yyyy-MM-dd HH:mm:ss").alias("at"))


@Q(f"WITH {LOG_SQL} SELECT event_id, level FROM logs WHERE level IN ('ERROR', 'WARN') AND contains(lower(message), '7') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY CASE level WHEN 'ERROR' THEN 0 ELSE 1 END, ts, event_id LIMIT 50 OFFSET 10")
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return logs.search(log_events(spark, d), levels=("ERROR", "WARN"), text="7", since="2024-01-05", until="2024-01-20", offset=10, limit=50).select("event_id", "level")


@Q(f"WITH {LOG_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, count(*) AS n, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM logs GROUP BY 1")
def hourly_buckets(spark: SparkSession, d: str) -> DataFrame:
    return logs.buckets(log_events(spark, d), "yyyy-MM-dd HH")


@Q(f"WITH {LOG_SQL} SELECT dayname(ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM logs GROUP BY 1")
def weekday_buckets(spark: SparkSession, d: str) -> DataFrame:
    return logs.buckets(log_events(spark, d), "EEEE")


@Q(f"WITH {LOG_SQL} SELECT left(message, 120) AS message, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_error_messages(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_messages(log_events(spark, d), "ERROR", 20)


@Q(f"WITH {LOG_SQL} SELECT file, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def errors_by_file(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).where("level = 'ERROR'").groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(15)


@Q(f"WITH {LOG_SQL} SELECT round(count(*) / greatest(epoch(max(ts) - min(ts)) / 3600.0, 0.1), 4) AS per_hour FROM logs")
def growth_rate(spark: SparkSession, d: str) -> DataFrame:
    return logs.growth(log_events(spark, d))


@Q(f"""WITH {LOG_SQL}, h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM logs GROUP BY 1), s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd, count(*) AS k FROM h)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, n, round((n - m) / sd, 4) AS z, CASE WHEN (n - m) / sd > 3 THEN 'high' ELSE 'medium' END AS severity FROM h, s WHERE k >= 3 AND sd > 0 AND (n - m) / sd > 2 ORDER BY 3 DESC, 1 LIMIT 20""")
def hourly_spikes(spark: SparkSession, d: str) -> DataFrame:
    return logs.spikes(log_events(spark, d))


@Q(f"WITH {LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(CASE WHEN level = 'ERROR' THEN 1.0 ELSE 0.0 END), 6) AS share FROM logs GROUP BY 1 HAVING avg(CASE WHEN level = 'ERROR' THEN 1.0 ELSE 0.0 END) > 0.22 ORDER BY 2 DESC, 1 LIMIT 10")
def error_peaks(spark: SparkSession, d: str) -> DataFrame:
    return logs.peaks(log_events(spark, d), share=0.22, limit=10)


HEALTH_SQL = f"""WITH {LOG_SQL}, t AS (SELECT max(ts) AS tmax FROM logs),
h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM logs GROUP BY 1), s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd FROM h), k AS (SELECT least(count(*), 20) AS spikes FROM h, s WHERE (n - m) / sd > 2),
e AS (SELECT avg(CASE WHEN level = 'ERROR' THEN 1.0 ELSE 0.0 END) AS rate, count(*) FILTER (WHERE level = 'ERROR' AND ts > tmax - INTERVAL 24 HOUR) AS e24, count(*) FILTER (WHERE level = 'ERROR' AND ts > tmax - INTERVAL 1 HOUR) AS e1 FROM logs, t),
x AS (SELECT *, (100 - least(30, floor(rate * 3000)) - least(30, 2 * e24) - least(40, 5 * spikes))::BIGINT AS score FROM e, k)
SELECT score, e24, e1, spikes::BIGINT AS spikes, CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 50 THEN 'degraded' ELSE 'critical' END AS status FROM x"""


@Q(HEALTH_SQL)
def log_health(spark: SparkSession, d: str) -> DataFrame:
    return logs.health(log_events(spark, d))


@Q("SELECT source, round(avg(CASE WHEN regexp_matches(text, '[0-9]{2}') THEN 1.0 ELSE 0.0 END), 6) AS ratio, avg(CASE WHEN regexp_matches(text, '[0-9]{2}') THEN 1.0 ELSE 0.0 END) >= 0.5 AS valid FROM documents GROUP BY 1")
def validate_format(spark: SparkSession, d: str) -> DataFrame:
    return logs.format_ratio(read(spark, d, "documents").select(F.col("source").alias("file"), F.col("text").alias("line")), r"[0-9]{2}").withColumnRenamed("file", "source")


@Q("SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'rotate' ELSE 'delete' END AS action FROM documents WHERE n_chars > 5000 OR doc_id % 100 > 90")
def cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 100).alias("age_days"))
    return logs.cleanup(files, days=90, size=5000).withColumnRenamed("path", "doc_id")


@Q("""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')) AS ip FROM documents) SELECT ip, count(DISTINCT doc_id) AS docs FROM i GROUP BY 1""")
def log_profile_ips(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)"), 1)).alias("ip"))
    return own.groupBy("ip").agg(F.countDistinct("doc_id").alias("docs"))


def _log_profile_sql() -> str:
    level = " ".join(f"WHEN regexp_matches(a, '{p}') THEN '{k}'" for k, p in logs.LEVEL_WORDS)
    fields = " UNION ALL ".join(f"SELECT source, '{k}' AS field, unnest(regexp_extract_all(a, '{p}', 1)) AS value FROM l" for k, p in logs.FIELDS)
    faults = " UNION ALL ".join(f"SELECT source, 'fault:{s}', '{p.removeprefix('(?i)')}' FROM l WHERE regexp_matches(a, '{p}')" for p, s in logs.FAULTS)
    return rf"""WITH u AS (SELECT source, trim(unnest(string_split(text, chr(10))), concat(' ', chr(9), chr(13), chr(10))) AS l FROM documents), l AS (SELECT *, regexp_replace(l, '[^\x00-\x7F]', ' ', 'g') AS a FROM u WHERE l <> ''),
f AS ({fields} UNION ALL {faults} UNION ALL SELECT source, 'lines', NULL FROM l UNION ALL SELECT source, 'level', CASE {level} END FROM l WHERE CASE {level} END IS NOT NULL),
w AS (SELECT source, min(t) AS lo, max(t) AS hi, count(t) AS k, count(DISTINCT e) AS d FROM (SELECT source, nullif(regexp_extract(a, '{logs.STAMP}'), '') AS t, left(regexp_replace(l, '{logs.PREFIX}', ''), 80) AS e FROM l) GROUP BY 1)
SELECT source, field, value, count(*) AS n FROM f GROUP BY 1, 2, 3 UNION ALL SELECT source, 'events', NULL, d FROM w UNION ALL SELECT source, 'from', lo, k FROM w WHERE k > 0 UNION ALL SELECT source, 'to', hi, k FROM w WHERE k > 0"""


@Q(_log_profile_sql())
def log_profile(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select(F.col("source").alias("file"), F.explode(F.split("text", "\n")).alias("line"))
    return logs.profile(lines).withColumnRenamed("file", "source")


# ------------------------------------------------------------------ history

PAIRS = """fc AS (SELECT DISTINCT l_orderkey c, l_partkey f FROM lineitem), m AS (SELECT c FROM fc GROUP BY 1 HAVING count(*) > 1), multi AS (SELECT count(*) AS n FROM m),
pairs AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS together FROM fc a JOIN fc b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2)"""


@Q(f"""WITH {PAIRS} SELECT file_a, file_b, together, round(together / n, 8) AS score, CASE WHEN together / n >= 0.6 THEN 'high' WHEN together / n >= 0.3 THEN 'medium' ELSE 'low' END AS risk
FROM pairs, multi WHERE together >= 2 ORDER BY together DESC, file_a, file_b LIMIT 50""")
def temporal_coupling(spark: SparkSession, d: str) -> DataFrame:
    return history.co_change(file_commits(spark, d), least=2).orderBy(F.desc("together"), "file_a", "file_b").limit(50)


@Q(f"""WITH {PAIRS}, p AS (SELECT file_a AS f, file_b AS o, together FROM pairs WHERE together >= 2 UNION ALL SELECT file_b, file_a, together FROM pairs WHERE together >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY together DESC, o) AS k FROM p)
SELECT f AS file, count(*) AS partners, round(avg(together), 6) AS mean, max(together) AS most, string_agg(o::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 5) AS top FROM r GROUP BY 1 HAVING count(*) >= 3""")
def temporal_hubs(spark: SparkSession, d: str) -> DataFrame:
    return history.hubs(history.co_change(file_commits(spark, d), least=2), partners=3, top=5)


@Q(f"WITH {PAIRS} SELECT CASE WHEN together / n >= 0.6 THEN 'high' WHEN together / n >= 0.3 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM pairs, multi GROUP BY 1")
def co_change_summary(spark: SparkSession, d: str) -> DataFrame:
    return history.co_change(file_commits(spark, d), least=1).groupBy("risk").agg(F.count("*").alias("n"))


@Q("SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits, CASE WHEN count(DISTINCT l_orderkey) > 150 THEN 'high' WHEN count(DISTINCT l_orderkey) > 50 THEN 'medium' ELSE 'low' END AS risk FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def churn_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return history.churn(file_commits(spark, d), 20)


@Q("SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS fixes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE regexp_matches(lower(o_orderpriority), 'urgent|high') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def bug_magnets(spark: SparkSession, d: str) -> DataFrame:
    commits = read(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("message"))
    return history.magnets(file_commits(spark, d), commits, "urgent|high", 10)


@Q("SELECT count(*) FILTER (WHERE regexp_matches(lower(o_orderpriority), 'urgent')) AS crises, CASE WHEN count(*) FILTER (WHERE regexp_matches(lower(o_orderpriority), 'urgent')) > 50 THEN 'high' WHEN count(*) FILTER (WHERE regexp_matches(lower(o_orderpriority), 'urgent')) > 20 THEN 'medium' ELSE 'low' END AS risk FROM orders")
def crisis_frequency(spark: SparkSession, d: str) -> DataFrame:
    return history.crises(read(spark, d, "orders").select(F.col("o_orderpriority").alias("message")), "urgent")


@Q("SELECT o_custkey AS author, count(*) AS commits, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def author_stats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("commits"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


FRAGILITY_SQL = """WITH f AS (SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS churn, max(l_quantity) AS complexity, count(DISTINCT l_suppkey) AS coupling, count(*) AS together, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1),
t AS (SELECT max(last_at) AS newest FROM f), s AS (SELECT file, 0.25 * least(churn / 100.0, 1) + 0.20 * least(complexity / 50.0, 1) + 0.20 * least(coupling / 50.0, 1) + 0.20 * least(together / 100.0, 1) + 0.15 * least(date_diff('day', last_at, newest) / 365.0, 1) AS x FROM f, t)
SELECT file, round(100 * x, 4) AS score, CASE WHEN round(100 * x, 4) >= 70 THEN 'critical' WHEN round(100 * x, 4) >= 50 THEN 'high' WHEN round(100 * x, 4) >= 30 THEN 'medium' ELSE 'low' END AS band FROM s"""


@Q(FRAGILITY_SQL)
def fragility(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    per = li.groupBy(F.col("l_partkey").alias("file")).agg(F.countDistinct("l_orderkey").alias("churn"), F.max("l_quantity").alias("complexity"), F.countDistinct("l_suppkey").alias("coupling"), F.count("*").alias("together"), F.max("l_shipdate").alias("at"))
    return history.fragility(per, li.agg(F.max("l_shipdate").alias("now")))


@Q("SELECT o_custkey AS repo, CASE WHEN b = 0 THEN 'current' WHEN b <= 3 THEN 'fresh' WHEN b <= 7 THEN 'aging' WHEN b <= 30 THEN 'stale' WHEN b <= 90 THEN 'old' ELSE 'abandoned' END AS level FROM (SELECT o_custkey, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS b FROM orders GROUP BY 1)")
def staleness_levels(spark: SparkSession, d: str) -> DataFrame:
    return history.staleness(read(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("at")))


@Q("SELECT doc_id, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) + len(regexp_extract_all(text, '(?:token|password) ?= ?\"?[0-9a-f]{8,}')) AS findings FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}|(?:token|password) ?= ?\"?[0-9a-f]{8,}')")
def commit_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return history.secret_scan(read(spark, d, "documents"))

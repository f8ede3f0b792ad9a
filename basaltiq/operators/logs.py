"""Log analytics over ``ts, level, message, file``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVEL = r"(?i)\b(CRITICAL|FATAL|ERROR|WARNING|WARN|INFO|DEBUG|TRACE)\b"


def parse_level(line: Column) -> Column:
    found = F.upper(F.regexp_extract(line, _LEVEL, 1))
    return F.when(found == "WARNING", "WARN").when(found == "FATAL", "CRITICAL").when(found == "", "INFO").otherwise(found)


def parse_timestamp(line: Column, year: int = 2000) -> Column:
    """The first timestamp in the line, in one of the known forms, with fractions and zone offsets; null without one. ``year`` is
    that of the form ``Jan 5 10:00:00``, which has none."""
    date, clock = r"(\d{4}[-/]\d{2}[-/]\d{2})", r"(\d{2}:\d{2}:\d{2})"
    found = F.regexp_extract(line, rf"{date}[T ]{clock}([.,]\d{{1,6}})?(Z|[+-]\d{{2}}:?\d{{2}})?", 0)
    plain = F.regexp_replace(F.translate(found, "T/,", " -."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    access = F.regexp_extract(line, rf"(\d{{2}}/[A-Z][a-z]{{2}}/\d{{4}}):{clock}", 0)
    syslog = F.regexp_replace(F.regexp_extract(line, rf"\b([A-Z][a-z]{{2}}) +(\d{{1,2}}) {clock}", 0), " +", " ")
    read = lambda text, form: F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(form))
    return F.coalesce(F.try_to_timestamp(F.nullif(plain, F.lit(""))), read(access, "dd/MMM/yyyy:HH:mm:ss"), F.when(syslog != "", read(F.concat(F.lit(f"{year} "), syslog), "yyyy MMM d HH:mm:ss")))


def _is_error() -> Column:
    return F.col("level") == "ERROR"


def levels(logs: DataFrame) -> DataFrame:
    per = logs.groupBy("level").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total")))).select("level", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def search(logs: DataFrame, *, levels: tuple[str, ...], text: str, since: str, until: str, offset: int, limit: int) -> DataFrame:
    """Errors first, then by time: sorted over all matches before the page is taken."""
    hit = logs.where(F.col("level").isin(*levels) & F.lower("message").contains(text.lower()) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return hit.orderBy(F.when(_is_error(), 0).otherwise(1), "ts", "event_id").offset(offset).limit(limit)


def buckets(logs: DataFrame, pattern: str) -> DataFrame:
    return logs.groupBy(F.date_format("ts", pattern).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(_is_error()).alias("errors"))


def top_messages(logs: DataFrame, level: str, k: int) -> DataFrame:
    return logs.where(F.col("level") == level).groupBy(F.left("message", F.lit(120)).alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(k)


def growth(logs: DataFrame) -> DataFrame:
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    hours = (seconds(F.max("ts")) - seconds(F.min("ts"))) / 3600.0
    return logs.agg(F.round(F.count("*") / F.greatest(hours, F.lit(0.1)), 4).alias("per_hour"))


def _hours(logs: DataFrame) -> DataFrame:
    per = logs.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    stats = per.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("sd"), F.count("*").alias("k"))
    return per.crossJoin(F.broadcast(stats)).where("k >= 3 and sd > 0").withColumn("z", (F.col("n") - F.col("m")) / F.col("sd"))


def spikes(logs: DataFrame, *, z: float = 2.0, limit: int = 20) -> DataFrame:
    """Hours whose count stands out among the hours that have any: a report of at most ``limit``."""
    out = _hours(logs).where(F.col("z") > z)
    out = out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", F.round("z", 4).alias("z"), F.when(F.col("z") > 3, "high").otherwise("medium").alias("severity"))
    return out.orderBy(F.desc("z"), "hour").limit(limit)


def peaks(logs: DataFrame, *, share: float, limit: int) -> DataFrame:
    per = logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg(F.when(_is_error(), 1.0).otherwise(0.0)).alias("s"))
    return per.where(F.col("s") > share).select("day", F.round("s", 6).alias("share")).orderBy(F.desc("share"), "day").limit(limit)


def health(logs: DataFrame) -> DataFrame:
    """One row; the reference point is the newest line, not the clock."""
    end = logs.agg(F.max("ts").alias("at"))
    since = lambda hours: _is_error() & (F.col("ts") > F.col("at") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    totals = logs.crossJoin(F.broadcast(end)).agg(F.avg(F.when(_is_error(), 1.0).otherwise(0.0)).alias("rate"), F.count_if(since(24)).alias("e24"), F.count_if(since(1)).alias("e1"))
    found = _hours(logs).where("z > 2").agg(F.least(F.count("*"), F.lit(20)).alias("spikes"))
    score = 100 - F.least(F.lit(30), F.floor(F.col("rate") * 3000)) - F.least(F.lit(30), 2 * F.col("e24")) - F.least(F.lit(40), 5 * F.col("spikes"))
    status = F.when(F.col("score") >= 80, "healthy").when(F.col("score") >= 50, "degraded").otherwise("critical")
    return totals.crossJoin(found).select(score.cast("long").alias("score"), "e24", "e1", F.col("spikes").cast("long").alias("spikes")).withColumn("status", status)


def format_ratio(rows: DataFrame, pattern: str) -> DataFrame:
    ok = F.avg(F.when(F.col("line").rlike(pattern), 1.0).otherwise(0.0))
    return rows.groupBy("file").agg(ok.alias("r")).select("file", F.round("r", 6).alias("ratio"), (F.col("r") >= 0.5).alias("valid"))


def cleanup(files: DataFrame, *, days: int, size: int) -> DataFrame:
    """What a clean-up would do to ``files (path, size, age_days)``; nothing is changed."""
    return files.where((F.col("size") > size) | (F.col("age_days") > days)).select("path", F.when(F.col("size") > size, "rotate").otherwise("delete").alias("action"))


#: Levels by their words, in order; the first that a line holds counts.
LEVEL_WORDS = (("ERROR", "ERROR|FATAL|CRITICAL"), ("WARN", "WARN|WARNING"), ("INFO", "INFO|NOTICE"), ("DEBUG", "DEBUG|TRACE"))
#: What in a line points to a fault, and how severe it is.
FAULTS = (
    ("Failed to connect", "high"), ("timeout", "medium"), ("Exception:", "high"), ("Traceback", "high"), ("null pointer", "high"), ("(?i)permission denied", "high"),
    ("segmentation fault", "critical"), ("out of memory", "critical"), ("disk full", "critical"), ("connection refused", "high"), ("panic:", "critical"), ("(?i)fatal:", "critical"),
)
#: Fields of a line.
FIELDS = (("ip", r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b"), ("user", r"(?i)\buser[=: ](\w+)"), ("status", r"\b([2-5][0-9]{2})\b"))
STAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
PREFIX = r"^[^ \t]+[ \t]+[^ \t]+[ \t]+"


def profile(lines: DataFrame) -> DataFrame:
    """``file, field, value, n`` for ``lines (file, line)``: what each file's lines hold.

    ``ip``, ``user``, ``status``: each value with its occurrences. ``level`` and ``fault:<severity>``: lines. ``lines``: those that are
    not blank. ``events``: different lines, without their first two words and beyond 80 signs. ``from`` and ``to``: the first and last
    timestamp, with the number of lines that have one. Signs outside of ASCII part words. Counted by value before anything is
    shuffled; null and blank lines hold nothing, and a file of none has no rows."""
    own = lines.select("file", F.btrim("line", F.lit(" \t\r\n")).alias("l")).where("l <> ''").withColumn("a", F.regexp_replace("l", r"[^\x00-\x7F]", " "))
    pair = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    found = [_fields(name, pattern) for name, pattern in FIELDS]
    level = F.coalesce(*[F.when(F.col("a").rlike(p), F.lit(k)) for k, p in LEVEL_WORDS])
    single = F.array(pair("lines", F.lit(None).cast("string")), F.when(level.isNotNull(), pair("level", level)), *[F.when(F.col("a").rlike(p), pair(f"fault:{s}", F.lit(p.removeprefix("(?i)")))) for p, s in FAULTS])
    counted = own.select("file", F.explode(F.concat(F.array_compact(single), *found)).alias("f")).groupBy("file", "f.field", "f.value").agg(F.count("*").alias("n"))
    stamp = F.nullif(F.regexp_extract("a", STAMP, 0), F.lit(""))
    whole = own.select("file", stamp.alias("t"), F.left(F.regexp_replace("l", PREFIX, ""), F.lit(80)).alias("e")).groupBy("file").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("t").alias("k"), F.count_distinct("e").alias("d"))
    ends = F.array(F.struct(F.lit("events").alias("field"), F.lit(None).cast("string").alias("value"), F.col("d").alias("n")), *[F.when(F.col("k") > 0, F.struct(F.lit(f).alias("field"), F.col(c).alias("value"), F.col("k").alias("n"))) for f, c in (("from", "lo"), ("to", "hi"))])
    return counted.unionByName(whole.select("file", F.explode(F.array_compact(ends)).alias("f")).select("file", "f.*"))


def _fields(name: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("a", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))

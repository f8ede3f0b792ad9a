"""Queries of sources, sinks and streams (S, K, Z)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators import incremental
from basaltiq.operators.graph import shared_folder
from basaltiq.registry import CORE
from basaltiq.sources import profiles, readers
from basaltiq.sources.tables import read
from basaltiq.streaming import streams

Q = CORE.query


JSON_TEXT = """CASE doc_id % 4 WHEN 0 THEN concat('{"a": ', n_chars, ', "b": [1, {"c": "]"}]}') WHEN 1 THEN concat('{"a": "', source, '", "b": null}')
WHEN 2 THEN '{"a": true, "b": {"x": {"y": [0]}}}' ELSE '{"a": -1.5, "b": "}{[["}' END"""


@Q(f"""WITH j AS (SELECT ({JSON_TEXT})::JSON AS j FROM documents), v AS (SELECT unnest([j->'a', j->'b']) AS v FROM j), t AS (SELECT json_type(v) AS t, regexp_replace(v::VARCHAR, '"[^"]*"', '', 'g') AS s FROM v)
SELECT CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t IS NULL OR t = 'NULL' THEN 'null' ELSE lower(t) END AS kind, count(*) AS n,
max(CASE WHEN t IN ('ARRAY', 'OBJECT') THEN list_max(list_transform(range(1, length(s) + 1), lambda i: length(regexp_replace(left(s, i), '[^\\[{{]', '', 'g')) - length(regexp_replace(left(s, i), '[^\\]}}]', '', 'g')))) ELSE 0 END) AS max_depth FROM t GROUP BY 1""")
def json_profile(spark: SparkSession, d: str) -> DataFrame:
    return readers.json_profile(read(spark, d, "documents").select(F.expr(JSON_TEXT).alias("props")), "props")


@Q("SELECT page_id, CASE WHEN regexp_matches(url, '[.](html|md)$') THEN 'document' ELSE 'other' END AS kind FROM pages")
def extension_classes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", readers.classify(F.col("url")).alias("kind"))


@Q("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '/(en|de)(/|$)') OR regexp_matches(url, 'page=2')")
def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    hidden = readers.ignored(F.col("url"), ["# folders", "en", "de", "!*page=2*"])
    return read(spark, d, "pages").where(~hidden).select("page_id")


@Q("SELECT '| r_regionkey | r_name |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM region")
def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    return readers.markdown(read(spark, d, "region"), ["r_regionkey"])


@Q("""WITH m AS (SELECT 'f' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), l AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(m.path, l.path) AS path, CASE WHEN m.path IS NULL THEN 'insert' WHEN l.path IS NULL THEN 'delete' ELSE 'update' END AS action FROM m FULL JOIN l ON m.path = l.path WHERE m.path IS NULL OR l.path IS NULL OR m.h <> l.h""")
def manifest_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))
    now = docs.where("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("hash")))
    return incremental.manifest_delta(docs.where("doc_id % 5 <> 0").drop("doc_id"), now.drop("doc_id"))


DETAILS = ("line_no", "item_id", "vendor_id", "quantity", "flag")
CELLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, nullif({c}::VARCHAR, '') AS v FROM sale_lines" for c in DETAILS)


@Q(f"""WITH c AS ({CELLS}), x AS (SELECT *, CASE WHEN regexp_matches(v, '{profiles.NUMBER}') THEN v::DOUBLE END AS x FROM c),
a AS (SELECT column_name, count(v) AS n_filled, count(*) - count(v) AS n_empty, count(DISTINCT v) AS n_distinct, count(x) * 2 > count(v) AS numeric, min(x) AS lo, max(x) AS hi, avg(x) AS mean FROM x GROUP BY 1),
d AS (SELECT DISTINCT column_name, v FROM c WHERE v IS NOT NULL), s AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY v) <= 5), j AS (SELECT column_name, string_agg(v, '|' ORDER BY v) AS samples FROM s GROUP BY 1)
SELECT column_name, n_filled, n_empty, n_distinct, CASE WHEN numeric THEN 'numeric' ELSE 'text' END AS kind, CASE WHEN numeric THEN lo END AS lo, CASE WHEN numeric THEN hi END AS hi, CASE WHEN numeric THEN round(mean, 2) END AS mean, samples FROM a LEFT JOIN j USING (column_name)""")
def column_details(spark: SparkSession, d: str) -> DataFrame:
    return profiles.column_details(read(spark, d, "sale_lines").select(*DETAILS))


def _streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over the events table to its end and give the sink's last result."""
    schema = read(spark, d, "events").schema
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # The table is one file or a folder of parts; a file stream reads folders.
    found = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").load(d)
    results: list[str] = []

    def keep(batch: DataFrame, k: int) -> None:
        results.append(f"{base}/out-{k}")
        batch.write.mode("overwrite").parquet(results[-1])

    streams.run_available(make(found), "", f"{base}/log", mode="complete", each=keep)
    return spark.read.parquet(results[-1])


@Q("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    got = _streamed(spark, d, lambda df: streams.tumbling(df, "ts", "1 hour", ["event_type"], late="60 days"))
    return got.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")

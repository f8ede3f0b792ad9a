"""Queries over blocks by indentation and over tags (X8, X10, X11). The files are made of the parts' order lines, with loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators import nesting
from basaltiq.registry import CORE
from basaltiq.sources.tables import read

Q = CORE.query

LINE = """concat(repeat('    ', CAST(l_quantity AS INT) % 10), CASE l_suppkey % 10 WHEN 0 THEN 'for x in rows:' WHEN 1 THEN 'while True:' WHEN 2 THEN concat('class C', l_suppkey, ':')
WHEN 3 THEN concat('def f', l_suppkey, '(a, b):') WHEN 4 THEN concat('def _g', l_suppkey, '(a: int) -> int:') WHEN 5 THEN 'store.execute(x)' WHEN 6 THEN 'return x' WHEN 7 THEN '# for later' WHEN 8 THEN '"text"' ELSE 'if x:' END)"""
SOLID_SQL = f"""src AS (SELECT l_partkey AS path, string_agg({LINE}, chr(10) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS text FROM lineitem GROUP BY 1),
l0 AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM src),
l AS (SELECT path, n, trim(line, ' ') AS bare, length(line) - length(ltrim(line, ' ')) AS indent FROM l0 WHERE NOT starts_with(trim(line, ' '), '#')),
nx AS (SELECT *, lead(bare) OVER w AS first, lead(indent) OVER w AS after FROM l WINDOW w AS (PARTITION BY path ORDER BY n)),
stop AS (SELECT h.path, h.n, min(m.n) AS stop FROM nx h JOIN l m ON h.path = m.path AND m.n > h.n AND m.indent <= h.indent WHERE h.after > h.indent GROUP BY 1, 2),
b AS (SELECT h.path, h.n, h.bare, h.indent, h.first, (SELECT max(m.n) FROM l m WHERE m.path = h.path AND m.n < coalesce(s.stop, 1000000000)) AS "end" FROM nx h LEFT JOIN stop s ON s.path = h.path AND s.n = h.n WHERE h.after > h.indent),
loops AS (SELECT * FROM b WHERE regexp_matches(bare, '^(for|while)')),
held AS (SELECT l.path, l.n, l.bare, l.indent, count(b.n) AS around FROM l LEFT JOIN loops b ON b.path = l.path AND l.n > b.n AND l.n <= b."end" GROUP BY 1, 2, 3, 4)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.expr(LINE).alias("line"))))
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(rows.alias("r")).select("path", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


@Q(f'WITH {SOLID_SQL} SELECT path, n, indent, "end" FROM b')
def block_extents(spark: SparkSession, d: str) -> DataFrame:
    return nesting.blocks(nesting.solid_lines(_sources(spark, d))).select("path", "n", "indent", "end")


@Q(f"WITH {SOLID_SQL} SELECT path, n, around + 1 AS depth FROM held WHERE around > 0 AND regexp_matches(bare, '^(for|while)')")
def nested_loops(spark: SparkSession, d: str) -> DataFrame:
    return nesting.nested_loops(_sources(spark, d))


@Q(f"""WITH {SOLID_SQL}, f AS (SELECT path, max(indent // 4) AS max_nesting, coalesce(max(around + 1) FILTER (WHERE regexp_matches(bare, '^(for|while)')), 0) AS nested_loops,
count(*) FILTER (WHERE around > 0 AND contains(bare, '.execute(')) AS store_calls FROM held GROUP BY 1)
SELECT *, CASE WHEN max_nesting > 8 OR store_calls > 3 THEN 'high' ELSE 'medium' END AS risk FROM f WHERE max_nesting > 6 OR nested_loops > 1 OR store_calls > 0""")
def performance_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return nesting.hotspots(_sources(spark, d))


@Q(f"""WITH {SOLID_SQL}, h AS (SELECT b.path, b.n, b.bare, b.first, b."end", regexp_extract(b.bare, '(def|class) (\\w+)', 2) AS name, count(*) FILTER (WHERE l.bare = 'return x') AS gives
FROM b JOIN l ON l.path = b.path AND l.n > b.n AND l.n <= b."end" WHERE regexp_matches(b.bare, '^(def|class) ') GROUP BY 1, 2, 3, 4, 5)
SELECT path, n, name, 'large_class' AS finding FROM h WHERE starts_with(bare, 'class') AND "end" - n + 1 > 5 UNION ALL SELECT path, n, name, 'no_return' FROM h WHERE starts_with(bare, 'def') AND gives = 0
UNION ALL SELECT path, n, name, 'no_docstring' FROM h WHERE NOT starts_with(name, '_') AND first <> '"text"' UNION ALL SELECT path, n, name, 'no_type_hints' FROM h WHERE starts_with(bare, 'def') AND NOT contains(bare, '->')""")
def structure_findings(spark: SparkSession, d: str) -> DataFrame:
    return nesting.structure(_sources(spark, d), class_lines=5)


VOID = ", ".join(f"'{t}'" for t in nesting.VOID_TAGS)


@Q(rf"""WITH t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(lower(html), '<(/?[a-z0-9_]+(?:[^>\n]*[^>/\n])?)>', 1), lambda t: regexp_extract(t, '^/?\w+')), lambda t: ltrim(t, '/') NOT IN ({VOID})) AS tags FROM pages),
s AS (SELECT page_id, list_reduce(list_concat(['|'], tags), lambda s, t: CASE WHEN NOT starts_with(t, '/') THEN s || ';' || t WHEN ends_with(s, ';' || ltrim(t, '/')) THEN left(s, length(s) - length(t)) ELSE replace(s, '|', ltrim(t, '/') || ' |') END) AS s FROM t)
SELECT page_id, split_part(s, '|', 1) AS unexpected, split_part(s, '|', 2) AS unclosed FROM s WHERE s <> '|'""")
def unclosed_tags(spark: SparkSession, d: str) -> DataFrame:
    """By page, the tags of each kind in their order."""
    found = nesting.unclosed_tags(read(spark, d, "pages"), "page_id", "html")
    names = lambda kind, form: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("finding") == kind, F.struct("at", "tag")))), lambda x: F.format_string(form, x["tag"])), "")
    return found.groupBy("page_id").agg(names("unexpected_closing_tag", "%s ").alias("unexpected"), names("unclosed_tag", ";%s").alias("unclosed"))

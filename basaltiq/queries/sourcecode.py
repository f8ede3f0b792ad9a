"""Queries over source texts and names.

The files are made of the parts' order lines: a line of code for each, in order; suppliers choose the statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators import code, graph
from basaltiq.registry import CORE
from basaltiq.sources.tables import call_edges, call_edges_sql, read

Q = CORE.query

LINE = """concat(repeat('    ', CAST(l_quantity AS INT) % 7), CASE l_suppkey % 10 WHEN 0 THEN concat('def f', l_suppkey, '(a, b, c=(1, 2)):') WHEN 1 THEN concat('class C', l_suppkey, '(Base):') WHEN 2 THEN 'pass'
WHEN 3 THEN concat('# TODO: check ', l_orderkey) WHEN 4 THEN concat('def g', l_suppkey, '(self):') WHEN 5 THEN 'x = (y[1' WHEN 6 THEN 'raise NotImplementedError' WHEN 7 THEN 'z = f(")") # bug: {' WHEN 8 THEN 'w = a)]' ELSE 'return x' END)"""
SOURCES_SQL = f"src AS (SELECT l_partkey AS path, string_agg({LINE}, chr(10) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS text FROM lineitem GROUP BY 1)"
LINES_SQL = SOURCES_SQL + ", l0 AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM src), l AS (SELECT *, trim(line, ' ') AS bare, length(line) - length(ltrim(line, ' ')) AS indent FROM l0)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.expr(LINE).alias("line"))))
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(rows.alias("r")).select("path", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


def _quoted(s: str) -> str:
    return s.replace("'", "''")


@Q(f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT path, n, strpos(line, regexp_extract(line, '(?i)\\b{t}\\s*:')) AS col, '{t}' AS tag, '{p}' AS priority FROM l WHERE regexp_matches(line, '(?i)\\b{t}\\s*:')" for t, p in code.COMMENT_TAGS.items()))
def comment_tags(spark: SparkSession, d: str) -> DataFrame:
    return code.comment_tags(_sources(spark, d))


@Q(rf"""WITH {LINES_SQL}, s AS (SELECT *, bare = '' OR regexp_matches(bare, '^(#|""|'''''')') AS skip FROM l),
x AS (SELECT path, n, line, first_value(CASE WHEN NOT skip THEN bare END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS d,
first_value(CASE WHEN NOT skip AND NOT regexp_matches(bare, '^(class |def )') THEN bare END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS c FROM s)
SELECT path, n, CASE WHEN regexp_matches(line, 'def\s+(\w+)\s*\([^)]*\)\s*:') AND regexp_matches(d, '^(pass$|raise NotImplementedError)') THEN 'empty_function' ELSE 'empty_class' END AS kind, regexp_extract(line, '(?:def|class)\s+(\w+)', 1) AS name
FROM x WHERE (regexp_matches(line, 'def\s+(\w+)\s*\([^)]*\)\s*:') AND regexp_matches(d, '^(pass$|raise NotImplementedError)')) OR (regexp_matches(line, 'class\s+(\w+)(\([^)]*\))?\s*:') AND c = 'pass')""")
def empty_bodies(spark: SparkSession, d: str) -> DataFrame:
    return code.empty_bodies(_sources(spark, d))


#: Marks before the bar (! unmatched, ? of another kind), open brackets after it.
STACK = """list_reduce(list_concat(['|'], string_split(signs, '')), lambda s, c: CASE WHEN c IN ('(', '[', '{') THEN s || c WHEN c IN (')', ']', '}') AND right(s, 1) <> '|'
  THEN CASE WHEN translate(right(s, 1), '([{', ')]}') = c THEN '' ELSE '?' END || left(s, length(s) - 1) WHEN c IN (')', ']', '}') THEN '!' || s ELSE s END)"""


@Q(f"""WITH {LINES_SQL}, b AS (SELECT path, n, regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"', '', 'g'), '#.*', ''), '[^\\[\\](){{}}]', '', 'g') AS signs FROM l), s AS (SELECT path, n, CASE WHEN signs = '' THEN '|' ELSE {STACK} END AS s FROM b)
SELECT path, n, length(s) - strpos(s, '|') AS unclosed, length(s) - length(replace(s, '!', '')) AS unmatched, length(s) - length(replace(s, '?', '')) AS mismatched FROM s WHERE s <> '|'""")
def unclosed_brackets(spark: SparkSession, d: str) -> DataFrame:
    return code.unclosed_brackets(_sources(spark, d))


FUNCTIONS_SQL = rf"""{LINES_SQL}, t AS (SELECT path, max(n) AS total FROM l GROUP BY 1), h AS (SELECT path, n, indent, line FROM l WHERE regexp_matches(line, '^\s*def\s+\w+\s*\(')),
e AS (SELECT h.path, h.n, min(l.n) AS stop FROM h JOIN l ON h.path = l.path AND l.n > h.n + 1 AND l.n < h.n + 200 AND l.bare <> '' AND NOT regexp_matches(l.bare, '^(#|//|/[*]|[*])') AND l.indent <= h.indent GROUP BY 1, 2),
f AS (SELECT h.path, h.n, regexp_extract(line, 'def\s+(\w+)', 1) AS name, coalesce(stop - 1, greatest(least(h.n + 199, total), h.n + 1)) - h.n AS length, CASE WHEN contains(line, 'a, b') THEN 3 ELSE 1 END AS params FROM h JOIN t USING (path) LEFT JOIN e ON h.path = e.path AND h.n = e.n)"""


@Q(f"WITH {FUNCTIONS_SQL} SELECT path, n, name, length FROM f")
def function_ends(spark: SparkSession, d: str) -> DataFrame:
    return code.functions(_sources(spark, d)).drop("params")


@Q(f"WITH {FUNCTIONS_SQL} SELECT path, n, name, CASE WHEN length >= 6 THEN 'long_function' ELSE 'many_params' END AS pattern FROM f WHERE length >= 6 OR params > 2")
def structural_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = code.functions(_sources(spark, d)).where("length >= 6 OR params > 2")
    return found.select("path", "n", "name", F.when(F.col("length") >= 6, "long_function").otherwise("many_params").alias("pattern"))


@Q(f"WITH {LINES_SQL}, t AS (SELECT path, max(n) AS total FROM l GROUP BY 1) SELECT path, n, indent // 4 AS depth FROM l JOIN t USING (path) WHERE bare <> '' AND NOT starts_with(bare, '#') AND indent // 4 > 4 AND n > 1 AND n < total")
def deep_nesting(spark: SparkSession, d: str) -> DataFrame:
    return code.deep_nesting(_sources(spark, d))


@Q(rf"""WITH {LINES_SQL}, r AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\s*class\s+\w+') THEN n END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS head FROM l)
SELECT path, head AS n, max(CASE WHEN n = head THEN regexp_extract(line, 'class\s+(\w+)', 1) END) AS name, count(*) FILTER (WHERE regexp_matches(line, '^\s+def\s+\w+')) AS methods FROM r WHERE head IS NOT NULL GROUP BY 1, 2""")
def class_methods(spark: SparkSession, d: str) -> DataFrame:
    return code.class_methods(_sources(spark, d))


def _masked_sql(text: str) -> str:
    for _, _, p in code.SENSITIVE:
        text = f"regexp_replace({text}, '{_quoted(p)}', '{code.PLACEHOLDER}', 'g')"
    return text


@Q(f"""WITH m AS (SELECT doc_id, text, {_masked_sql('text')} AS m FROM documents), a AS (SELECT *, CASE WHEN regexp_matches(text, '{code.VULGAR}') THEN 'block' WHEN m <> text THEN 'mask' ELSE 'allow' END AS action FROM m)
SELECT doc_id, action, sha256(CASE action WHEN 'block' THEN '' WHEN 'mask' THEN m ELSE text END) AS shown FROM a""")
def security_rules(spark: SparkSession, d: str) -> DataFrame:
    return code.filtered(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "action", F.sha2("text", 256).alias("shown"))


@Q(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, '{s}' AS severity FROM documents WHERE regexp_matches(text, '{_quoted(p)}')" for n, s, p in code.SENSITIVE))
def sensitive_findings(spark: SparkSession, d: str) -> DataFrame:
    return code.sensitive(read(spark, d, "documents"), "doc_id", "text")


NAMES_SQL = """c AS (SELECT l_orderkey * 8 + l_linenumber AS call_id, 's' || l_suppkey AS file, CASE l_partkey % 7 WHEN 0 THEN 'len' WHEN 1 THEN 'self.f' || l_partkey WHEN 2 THEN 'f' || l_partkey WHEN 3 THEN 'm' || (l_partkey % 50) || '.f' || l_partkey
WHEN 4 THEN 'self.a.f' || l_partkey WHEN 5 THEN 'f' || (l_partkey + 100000) ELSE 'k' || (l_partkey % 9) || '.b.run' END AS full_name FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)),
loc AS (SELECT DISTINCT 's' || l_suppkey AS file, 'f' || l_partkey AS name FROM lineitem WHERE l_quantity > 30), imp AS (SELECT 's' || s_suppkey AS file, 'm' || (s_suppkey % 50) AS alias, 'lib' || s_nationkey AS path, 'mod' || s_nationkey AS name FROM supplier),
known AS (SELECT 'f' || p_partkey AS name, 'pkg' || p_size AS path FROM part UNION ALL SELECT 'k' || p_size, 'kit' || p_partkey FROM part)"""


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    li, s, p = (read(spark, d, t) for t in ("lineitem", "supplier", "part"))
    part = F.col("l_partkey")
    text = lambda *cols: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cols])
    kind = part % 7
    full = F.when(kind == 0, "len").when(kind == 1, text("self.f", part)).when(kind == 2, text("f", part)).when(kind == 3, text("m", part % 50, ".f", part)).when(kind == 4, text("self.a.f", part)).when(kind == 5, text("f", part + 100000)).otherwise(text("k", part % 9, ".b.run"))
    rows = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    calls = rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call_id"), text("s", F.col("l_suppkey")).alias("file"), full.alias("full_name"))
    local = li.where("l_quantity > 30").select(text("s", F.col("l_suppkey")).alias("file"), text("f", part).alias("name")).distinct()
    imports = s.select(text("s", F.col("s_suppkey")).alias("file"), text("m", F.col("s_suppkey") % 50).alias("alias"), text("lib", F.col("s_nationkey")).alias("path"), text("mod", F.col("s_nationkey")).alias("name"))
    known = p.select(text("f", F.col("p_partkey")).alias("name"), text("pkg", F.col("p_size")).alias("path")).unionByName(p.select(text("k", F.col("p_size")).alias("name"), text("kit", F.col("p_partkey")).alias("path")))
    return calls, local, imports, known


@Q(f"""WITH {NAMES_SQL}, p AS (SELECT *, string_split(full_name, '.') AS parts FROM c), x AS (SELECT call_id, file, parts[-1] AS called, len(parts) > 1 AND parts[1] = 'self' AND len(parts) < 3 AS own, CASE WHEN len(parts) > 1 AND NOT (parts[1] = 'self' AND len(parts) > 2) THEN parts[1] ELSE parts[-1] END AS lookup FROM p),
k AS (SELECT name, min(path) AS path FROM known GROUP BY 1)
SELECT call_id, CASE WHEN own THEN called WHEN loc.name IS NOT NULL THEN lookup WHEN imp.path IS NOT NULL THEN imp.name ELSE lookup END AS called_name, CASE WHEN own OR loc.name IS NOT NULL THEN x.file WHEN imp.path IS NOT NULL THEN imp.path ELSE k.path END AS called_path
FROM x LEFT JOIN loc ON x.file = loc.file AND lookup = loc.name LEFT JOIN imp ON x.file = imp.file AND lookup = alias LEFT JOIN k ON lookup = k.name WHERE called <> 'len' AND (own OR loc.name IS NOT NULL OR imp.path IS NOT NULL OR k.path IS NOT NULL)""")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    return code.resolve_calls(*_names(spark, d))


@Q(f"""WITH {NAMES_SQL}, b AS (SELECT file, 'C' || call_id AS child, CASE WHEN full_name = 'len' THEN 'object' ELSE full_name END AS base FROM c), k AS (SELECT name, min(path) AS path FROM known GROUP BY 1),
x AS (SELECT *, string_split(base, '.')[1] AS first, string_split(base, '.')[-1] AS last FROM b WHERE base <> 'object')
SELECT child, CASE WHEN loc.name IS NOT NULL OR k.path IS NOT NULL THEN base WHEN i.path IS NOT NULL THEN i.name ELSE last END AS parent,
CASE WHEN loc.name IS NOT NULL THEN x.file WHEN i.path IS NOT NULL THEN i.path WHEN k.path IS NOT NULL THEN k.path WHEN j.path IS NOT NULL THEN j.path ELSE g.path END AS parent_path
FROM x LEFT JOIN loc ON x.file = loc.file AND base = loc.name LEFT JOIN imp i ON x.file = i.file AND base = i.alias LEFT JOIN k ON base = k.name LEFT JOIN imp j ON x.file = j.file AND first = j.alias LEFT JOIN k g ON first = g.name
WHERE loc.name IS NOT NULL OR i.path IS NOT NULL OR k.path IS NOT NULL OR (contains(base, '.') AND (j.path IS NOT NULL OR g.path IS NOT NULL))""")
def inheritance_resolution(spark: SparkSession, d: str) -> DataFrame:
    calls, local, imports, known = _names(spark, d)
    bases = calls.select("file", F.concat(F.lit("C"), F.col("call_id").cast("string")).alias("child"), F.when(F.col("full_name") == "len", "object").otherwise(F.col("full_name")).alias("base"))
    return code.resolve_bases(bases, local, imports, known)


CG = call_edges_sql()
START = "(SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


@Q(f"""WITH RECURSIVE {CG}, e AS (SELECT src, dst FROM edges WHERE weight = 1), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, depth) AS (SELECT {START}, 0::BIGINT UNION SELECT dst, depth + 1 FROM b JOIN r ON src = id WHERE depth < 2),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1) SELECT id, depth, (SELECT count(*) FROM e WHERE dst = id) AS fan_in, (SELECT count(*) FROM e WHERE src = id) AS fan_out FROM m""")
def explore_relationships(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut(call_edges(spark, d))
    start = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    return graph.explore(e.where("weight = 1"), start, direction="both", depth=2)


@Q("SELECT min(p_partkey) AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'ring') GROUP BY p_name")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(F.lower("p_name").contains("ring")).groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("id"))


def _marks_sql() -> str:
    any_of = lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"
    tags = ", ".join(f"CASE WHEN {any_of(ws)} THEN '{t}' END" for t, ws in code.TAGS.items())
    return rf"""SELECT doc_id, CASE WHEN {any_of(code.CRITICAL)} THEN 'high' ELSE 'low' END AS criticality, array_to_string(list_concat(list_filter(w, lambda x: regexp_full_match(x, '[A-Z][a-z]+([A-Z][a-z]+)+')), list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{{2,}}')))[1:5], ',') AS concepts,
array_to_string(regexp_extract_all(text, '\b((?:src|app|lib|packages)/[\w/.-]+)', 1)[1:3], ',') AS modules, array_to_string(list_filter([{tags}], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT *, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM documents)"""


@Q(_marks_sql())
def knowledge_marks(spark: SparkSession, d: str) -> DataFrame:
    return code.knowledge_marks(read(spark, d, "documents"), "doc_id", "text")


@Q("""SELECT * FROM (SELECT doc_id AS id, (contains(lower(text || ' ' || lang), 'license') OR contains(lower(source), 'license'))::BIGINT + (contains(lower(text || ' ' || lang), 'copyright') OR contains(lower(source), 'copyright'))::BIGINT + (contains(lower(text || ' ' || lang), 'src1') OR contains(lower(source), 'src1'))::BIGINT AS score
FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 10""")
def golden_relevance(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang").alias("tags"), F.array("source").alias("applies_to"))
    return code.relevant(entries, "the license, (copyright) in src1!")


@Q("SELECT CASE WHEN len(p) > 1 THEN p[2] ELSE 'unknown' END AS project, count(*) AS pages FROM (SELECT list_filter(string_split(regexp_replace(split_part(url, '?', 1), '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages) GROUP BY 1")
def project_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the first folder of their address."""
    parts = F.filter(F.split(F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "^[a-z]+://", ""), "/"), lambda x: x != "")
    return read(spark, d, "pages").groupBy(F.coalesce(F.get(parts, 1), F.lit("unknown")).alias("project")).agg(F.count("*").alias("pages"))

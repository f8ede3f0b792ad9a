"""Extraction, audit and conversation queries (X, C, S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators import conversations, extract, secrets
from basaltiq.registry import CORE
from basaltiq.sources.tables import read

Q = CORE.query


def _q(s: str) -> str:
    return s.replace("'", "''")


SCAN = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, '{s}' AS severity, len(regexp_extract_all(text, '{_q(p)}')) AS n FROM documents WHERE regexp_matches(text, '{_q(p)}')" for n, s, p in extract.RULES)


@Q(SCAN)
def rule_scan(spark: SparkSession, d: str) -> DataFrame:
    return extract.scan(read(spark, d, "documents"))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


@Q(f"WITH {LINES} " + " UNION ALL ".join(f"SELECT doc_id, line, strpos(l, regexp_extract(l, '({_q(p)})', 1)) AS col, '{n}' AS rule, regexp_extract(l, '({_q(p)})', 1) AS hit FROM l WHERE regexp_matches(l, '{_q(p)}')" for n, _, p in extract.RULES))
def line_findings(spark: SparkSession, d: str) -> DataFrame:
    return extract.findings(read(spark, d, "documents"))


def _candidates_sql() -> str:
    any_of = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
    each = [f"SELECT doc_id, line, l, '{k}' AS kind, '{s}' AS severity, NULL AS name, unnest(regexp_extract_all(l, '{_q(p)}')) AS value FROM l" for k, p, s in secrets.TOKENS]
    risk = " ".join(f"WHEN contains(lower(name), '{w}') THEN {r}" for w, r in secrets.RISK)
    return rf"""WITH {LINES}, m AS (SELECT doc_id, line, l, unnest(regexp_extract_all(l, '{_q(secrets.ASSIGNED)}')) AS m FROM l),
c AS ({" UNION ALL ".join(each)} UNION ALL SELECT doc_id, line, l, 'high_risk_variable', NULL, regexp_extract(m, '(?i)^({secrets.NAMES})', 1), regexp_extract(m, '{_q(secrets.VALUE)}$', 1) FROM m),
e AS (SELECT *, CASE WHEN name IS NULL THEN NULL {risk} ELSE {secrets.NO_RISK} END::DOUBLE AS risk, {any_of("lower(value)", secrets.PLACEHOLDERS)} AS stands, {any_of("l", secrets.ENVIRONMENT)} AS env,
  log2(length(value)) - list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: (length(value) - length(replace(value, c, ''))) * log2(length(value) - length(replace(value, c, ''))))) / length(value) AS h FROM c)
SELECT doc_id, line, kind, coalesce(severity, CASE WHEN risk > 0.7 THEN 'high' ELSE 'medium' END) AS severity, rtrim(regexp_replace(name, '[=:]$', '')) AS name, length(value) AS n_chars, round(h, 5) AS entropy, risk,
round(CASE WHEN name IS NULL THEN least(1.0, h / 4 + 0.5) * CASE WHEN stands THEN {secrets.DAMPED} ELSE 1.0 END ELSE risk * CASE WHEN stands OR env THEN {secrets.DAMPED} ELSE h / 4 + 0.5 END END::DOUBLE, 5) AS confidence,
CASE WHEN stands THEN 'placeholder' WHEN env THEN 'environment' ELSE 'candidate' END AS reason FROM e"""


@Q(_candidates_sql())
def secret_candidates(spark: SparkSession, d: str) -> DataFrame:
    return secrets.candidates(read(spark, d, "documents"), "doc_id", "text")


def _mask_sql() -> str:
    x = "text"
    for n, s, p in extract.RULES:
        if s in ("critical", "high", "medium"):
            x = f"regexp_replace({x}, '{_q(p)}', '[{n}]', 'g')"
    return x


@Q(f"SELECT doc_id, sha256({_mask_sql()}) AS masked FROM documents")
def mask_secrets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(extract.mask(F.col("text")), 256).alias("masked"))


def _any(*levels: str) -> str:
    return _q("|".join(f"(?:{p})" for _, s, p in extract.RULES if s in levels))


@Q(f"SELECT CASE WHEN regexp_matches(text, '{_any('critical')}') THEN 'block' WHEN regexp_matches(text, '{_any('high', 'medium')}') THEN 'mask' ELSE 'allow' END AS action, count(*) AS n FROM documents GROUP BY 1")
def security_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(extract.action(F.col("text")).alias("action")).agg(F.count("*").alias("n"))


@Q("WITH c AS (SELECT p_partkey, unnest(string_split(p_name || p_type, '')) AS c FROM part), n AS (SELECT p_partkey, c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2) SELECT p_partkey, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) AS entropy FROM n GROUP BY 1")
def text_entropy(spark: SparkSession, d: str) -> DataFrame:
    return extract.entropy(read(spark, d, "part").withColumn("t", F.concat("p_name", "p_type")), "p_partkey", "t")


KINDS = ", ".join(f"CASE WHEN regexp_matches(lower(content), '{p}') THEN '{k}' END" for k, p in extract.TYPES.items())


@Q(f"""WITH s AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), '.'), '.')) AS s, generate_subscripts(string_split(replace(text, chr(10), '.'), '.'), 1) AS i FROM documents), c AS (SELECT doc_id, i, trim(s, ' ') AS content FROM s),
k AS (SELECT doc_id, i, content, unnest(list_filter([{KINDS}], lambda x: x IS NOT NULL)) AS kind FROM c WHERE length(content) >= 15)
SELECT doc_id, kind, content FROM k QUALIFY row_number() OVER (PARTITION BY kind, md5(lower(left(content, 100))) ORDER BY doc_id, i) = 1""")
def knowledge_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.knowledge_chunks(read(spark, d, "documents"))


@Q(r"""SELECT doc_id, len(regexp_extract_all(text, '\b(if|for|while|and|or|except|case)\b')) + 1 AS cyclomatic, round(len(regexp_extract_all(text, '(?m)^\s*#')) / len(string_split(text, chr(10))), 6) AS comment_density,
round(greatest(0, 100 - 0.23 * len(regexp_extract_all(text, '\b(if|for|while|and|or|except|case)\b')) - 16.2 * ln(len(string_split(text, chr(10)))) / 10), 4) AS maintainability FROM documents""")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in extract.complexity(F.col("text")).items()])


@Q(r"""SELECT doc_id, round((least(len(regexp_extract_all(text, '\b(very|really|just|quite)\b')) * 5, 100) + least(len(regexp_extract_all(text, '!!')) * 3, 100) + least(len(regexp_extract_all(text, '[*#$%&]{3}')) * 2, 100) + least(len(regexp_extract_all(text, '\b(thing|stuff)\b')) * 5, 100)) / 4, 4) AS slop FROM documents""")
def slop_score(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", extract.slop(F.col("text")).alias("slop"))


@Q("""WITH c AS (SELECT doc_id, greatest(len(regexp_extract_all(text, '[A-Za-z]+')), 1) AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, greatest(len(regexp_extract_all(text, '(?i)[aeiouy]+')), 1) AS y FROM documents) SELECT doc_id, round(206.835 - 1.015 * w / s - 84.6 * y / w, 6) AS flesch FROM c""")
def readability(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", extract.readability(F.col("text")).alias("flesch"))


@Q("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS target FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return extract.links(read(spark, d, "pages"))


@Q("SELECT lang, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.5 END), 6) AS weight FROM documents GROUP BY 1")
def length_class(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.5)), 6).alias("weight"))


@Q(r"""WITH x AS (SELECT doc_id, text, lower(text) AS t FROM documents) SELECT doc_id, round(0.3 * least(1.0, (contains(t, 'service')::INT + contains(t, 'layer')::INT + contains(t, 'module')::INT) / 2) + 0.2 * least(1.0, (contains(t, 'critical')::INT + contains(t, 'must')::INT + contains(t, 'never')::INT) / 2)
+ 0.2 * CASE WHEN length(text) > 1000 THEN 1.0 ELSE 0.5 END + 0.1 * least(1.0, len(regexp_extract_all(text, '\b[A-Z][a-z]+[A-Z][a-z]+\b')) / 5) + 0.1 * least(1.0, len(regexp_extract_all(text, '\b[a-z]+_[a-z]+\b')) / 3) + 0.1 * least(1.0, length(text) / 500), 5) AS importance FROM x""")
def importance_score(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.round(extract.importance(F.col("text")), 5).alias("importance"))


@Q("SELECT p_partkey AS id, CASE WHEN regexp_matches(upper(p_name), 'PART 1') THEN 1 WHEN regexp_matches(p_type, 'ST') THEN 2 END AS by_rank FROM part WHERE regexp_matches(upper(p_name), 'PART 1') OR regexp_matches(p_type, 'ST')")
def security_hygiene(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.upper("p_name").rlike("PART 1"), 1).when(F.col("p_type").rlike("ST"), 2)
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), rank.alias("by_rank")).where("by_rank is not null")


@Q("SELECT doc_id FROM documents WHERE n_chars < 40 OR text ILIKE '%pass%' OR text ILIKE '%todo%'")
def stub_detection(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").where((F.col("n_chars") < 40) | t.ilike("%pass%") | t.ilike("%todo%")).select("doc_id")


# ------------------------------------------------------------------ conversations


@Q("SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def conversation_bounds(spark: SparkSession, d: str) -> DataFrame:
    return conversations.bounds(read(spark, d, "conversations"))


@Q(" UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) FILTER (WHERE regexp_matches(lower(text), '{p}')) AS turns FROM conversations" for k, p in conversations.LANGUAGES.items()))
def keyword_profile(spark: SparkSession, d: str) -> DataFrame:
    return conversations.keyword_profile(read(spark, d, "conversations"))


@Q("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 1500")
def conversation_compaction(spark: SparkSession, d: str) -> DataFrame:
    return conversations.compact(read(spark, d, "conversations"), 1500)


#: Announcements and quoted files stand for words of the texts, which have none.
SPOKEN = "replace(replace(replace(text, ' und ', ' decided to '), ' la ', ' `src/la.py` '), ' of ', ' let me `of.md` ')"


def _digest_sql() -> str:
    announced = ", ".join(f"nullif(regexp_extract(t, '{_q(p)}'), '')" for p in conversations.DECISIONS)
    return f"""WITH c AS (SELECT conv_id, turn, role, {SPOKEN} AS t FROM conversations WHERE text IS NOT NULL), a AS (SELECT * FROM c WHERE role = 'assistant'),
d AS (SELECT conv_id, turn, left(coalesce({announced}), 100) AS value FROM a), f AS (SELECT conv_id, value, min(turn) AS turn FROM (SELECT conv_id, turn, unnest(regexp_extract_all(t, '{conversations.FILE}', 1)) AS value FROM c) GROUP BY 1, 2)
SELECT conv_id, 'reasoning' AS kind, 1 AS place, left(t, 500) AS value FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) = 1
UNION ALL SELECT conv_id, 'decision', row_number() OVER w, value FROM d WHERE value IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, value) QUALIFY row_number() OVER w <= 5
UNION ALL SELECT conv_id, 'file', row_number() OVER w, value FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn, value) QUALIFY row_number() OVER w <= 15"""


@Q(_digest_sql())
def conversation_digest(spark: SparkSession, d: str) -> DataFrame:
    return conversations.digest(read(spark, d, "conversations").withColumn("text", F.expr(SPOKEN)))


@Q("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY 1")
def role_stats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@Q("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def settings_flat(spark: SparkSession, d: str) -> DataFrame:
    return conversations.settings_flat(read(spark, d, "events"), "event_id", "props")


@Q("SELECT CASE WHEN ends_with(lower(split_part(split_part(url, '?', 1), '#', 1)), '.html') THEN 'document' WHEN contains(url, '/en/') THEN 'code' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def file_classification(spark: SparkSession, d: str) -> DataFrame:
    path = F.lower(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)))
    kind = F.when(F.endswith(path, F.lit(".html")), "document").when(F.col("url").contains("/en/"), "code").otherwise("other")
    return read(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))

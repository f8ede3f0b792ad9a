"""Search and ranking queries (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.functions.text import token_estimate
from basaltiq.operators import search
from basaltiq.operators.textindex import TextIndex
from basaltiq.plans.dsl import safe_pattern
from basaltiq.registry import CORE
from basaltiq.sources.tables import read

Q = CORE.query


def _count(field: str, word: str) -> str:
    return f"((length({field}) - length(replace({field}, '{word}', ''))) // {len(word)})"


@Q(f"""WITH s AS (SELECT doc_id, round(least(1.0, (CASE WHEN {_count('lower(text)', 'tion')} > 0 THEN least(1.0, 0.3 + 0.1 * {_count('lower(text)', 'tion')}) ELSE 0 END + CASE WHEN {_count('source', 'tion')} > 0 THEN 0.4 ELSE 0 END) / 2), 6) AS score FROM documents) SELECT doc_id, score FROM s WHERE score > 0""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword(read(spark, d, "documents"), ["text", "source"], "tion").select("doc_id", "score")


@Q("SELECT page_id, 1.0::DOUBLE AS score FROM pages WHERE regexp_matches(lower(url), '(?s)^.*example.*page=[0-9].*$')")
def glob_search(spark: SparkSession, d: str) -> DataFrame:
    return search.glob(read(spark, d, "pages"), "url", "*example*page=[0-9]*").select("page_id", "score")


@Q("SELECT doc_id, round(least(1.0, 0.3 + 0.15 * len(regexp_extract_all(text, '[0-9]{3,}'))), 6) AS score FROM documents WHERE regexp_matches(text, '[0-9]{3,}')")
def regex_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(read(spark, d, "documents"), "/[0-9]{3,}/", "text").select("doc_id", "score")


@Q("SELECT doc_id, 0.9::DOUBLE AS score FROM documents WHERE (contains(lower(text), 'the') AND contains(lower(text), 'license')) OR NOT contains(lower(text), 'e')")
def boolean_search(spark: SparkSession, d: str) -> DataFrame:
    return search.boolean(read(spark, d, "documents"), "text", "the AND license OR NOT e").select("doc_id", "score")


@Q()
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(read(spark, d, "part"), "p_name", "red plates").select("p_partkey", "score")


@Q("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 2000 AND source IN ('src0', 'src3') AND lang <> 'de'")
def post_filters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("n_chars").between(200, 2000) & F.col("source").isin("src0", "src3") & (F.col("lang") != "de")).select("doc_id", "lang", "n_chars")


@Q("""WITH a AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents), b AS (SELECT *, greatest(p - 60, 1) AS s, least(p + 66, length(text)) AS e FROM a WHERE p > 0)
SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || substring(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '...' ELSE '' END AS snippet FROM b""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return search.snippets(read(spark, d, "documents"), "text", "license").select("doc_id", "snippet")


@Q("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
t AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN ('license', 'version', 'password') GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 5) AS score FROM t JOIN f USING (term), s GROUP BY 1""")
def full_text_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(read(spark, d, "documents"), "doc_id", "text", ["license", "version", "password"])


@Q("SELECT p_partkey, p_name FROM part WHERE p_name = 'red plate' OR regexp_matches(p_name, '(?i)^HOT RI[MN]G$')")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where((F.col("p_name") == "red plate") | F.col("p_name").rlike(safe_pattern("(?i)^HOT RI[MN]G$"))).select("p_partkey", "p_name")


@Q("""WITH h AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5), x AS (SELECT l_partkey AS hit, l_suppkey AS related, count(*) AS weight FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM h) GROUP BY 1, 2)
SELECT hit, related, weight FROM x QUALIFY row_number() OVER (PARTITION BY hit ORDER BY weight DESC, related) <= 10""")
def graph_enrichment(spark: SparkSession, d: str) -> DataFrame:
    from basaltiq.operators.windows import top_per_group

    hits = read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select(F.col("p_partkey").alias("hit"))
    near = read(spark, d, "lineitem").select(F.col("l_partkey").alias("hit"), F.col("l_suppkey").alias("related")).join(F.broadcast(hits), "hit")
    return top_per_group(near.groupBy("hit", "related").agg(F.count("*").alias("weight")), ["hit"], [F.desc("weight"), F.col("related")], 10)


@Q("""WITH s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0)
SELECT query, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 20""")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    return search.nearest(v, v.where("vec_id % 20 = 0"), 20)


@Q("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS bucket, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""")
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return search.hashed_vector(read(spark, d, "documents"), "doc_id", "text")


@Q("SELECT p_partkey FROM part WHERE levenshtein(p_name, 'Red_Plate') <= 2 OR levenshtein(lower(translate(p_name, '_- #', '')), 'redplate') <= 2")
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy_names(read(spark, d, "part"), "p_name", "Red_Plate", 2).select("p_partkey")


@Q("SELECT doc_id FROM documents WHERE contains(lower(text), 'copyright') OR contains(lower(source), '19')")
def content_search(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.lower("text").contains("copyright") | F.lower("source").contains("19")).select("doc_id")


@Q("SELECT id, max(score) AS score FROM (SELECT c_custkey AS id, 0.9::DOUBLE AS score FROM customer WHERE contains(c_name, '77') UNION ALL SELECT s_suppkey, 0.7 FROM supplier WHERE contains(s_name, '7') UNION ALL SELECT p_partkey, 0.5 FROM part WHERE contains(p_name, '77')) GROUP BY 1")
def related_code_merge(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, key, name, word, score: read(spark, d, t).where(F.col(name).contains(word)).select(F.col(key).alias("id"), F.lit(score).alias("score"))
    both = part("customer", "c_custkey", "c_name", "77", 0.9).unionByName(part("supplier", "s_suppkey", "s_name", "7", 0.7)).unionByName(part("part", "p_partkey", "p_name", "77", 0.5))
    return both.groupBy("id").agg(F.max("score").alias("score"))


@Q("""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM documents)
SELECT doc_id, round(len(list_intersect(w, ['that', 'with', 'license', 'this'])) / greatest(len(w), 4), 6) AS overlap FROM w""")
def task_rerank(spark: SparkSession, d: str) -> DataFrame:
    return search.task_overlap(read(spark, d, "documents"), "text", "that with license this").select("doc_id", "overlap")


@Q("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM documents),
x AS (SELECT doc_id AS id, contains(lower(text), 'the that') AS p, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'that') THEN 1 ELSE 0 END AS n, n_chars,
round(len(list_intersect(w, ['that', 'with', 'this'])) / greatest(len(w), 3), 6) AS semantic, least(coalesce(c.n, 0) / 8.0, 1) AS graph FROM documents JOIN w USING (doc_id) LEFT JOIN c ON conv_id = doc_id),
y AS (SELECT id, round(0.30 * least(n_chars / 10000.0, 1) + 0.25 * semantic + 0.20 * graph + 0.10 * greatest(0, 1 - (id % 400) / 365.0) + 0.15 * CASE WHEN p THEN 1.0 WHEN n = 2 THEN 0.8 WHEN n > 0 THEN 0.3 + 0.4 * n / 2 ELSE 0 END, 6) AS score FROM x)
SELECT id, score FROM y WHERE score >= 0.05 ORDER BY 2 DESC, 1 LIMIT 50""")
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    """Length, word overlap with the task, links from conversations, age and phrase as the five signals."""
    links = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("links"))
    docs = search.task_overlap(read(spark, d, "documents"), "text", "that with this").join(links, "doc_id", "left")
    signals = docs.select(
        F.col("doc_id").alias("id"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("fts"), F.col("overlap").alias("semantic"), F.least(F.coalesce("links", F.lit(0)) / 8.0, F.lit(1.0)).alias("graph"),
        F.greatest(F.lit(0.0), 1 - (F.col("doc_id") % 400) / 365.0).alias("freshness"), search.precision(F.col("text"), "the that").alias("precision"),
    )
    return search.composite(signals).select("id", "score")


#: Providers of the federation: name, table, key, searched text and fixed score; the documents' score counts occurrences.
SOURCES = (
    ("code", "part", "p_partkey", "p_name", 0.9), ("types", "part", "p_partkey", "p_type", 0.85), ("brands", "part", "p_partkey", "p_brand", 0.85), ("authors", "customer", "c_custkey", "c_name", 0.75), ("teams", "customer", "c_custkey", "c_mktsegment", 0.7),
    ("owners", "supplier", "s_suppkey", "s_name", 0.7), ("tickets", "orders", "o_orderkey", "o_orderpriority", 0.65), ("states", "orders", "o_orderkey", "o_orderstatus", 0.65), ("logs", "events", "event_id", "props", 0.6), ("events", "events", "event_id", "event_type", 0.55),
    ("files", "pages", "page_id", "url", 0.6), ("content", "pages", "page_id", "html", 0.5), ("benchmarks", "benchmark", "item_id", "text", 0.5), ("chats", "conversations", "conv_id", "text", 0.45), ("origins", "documents", "doc_id", "source", 0.4),
)


def _provider(table: str, key: str, text: str, score: float) -> search.Provider:
    return lambda s, d, q: read(s, d, table).where(F.col(text).contains(q)).select(F.col(key).alias("id"), F.lit(score).alias("score")).distinct()


PROVIDERS = {name: _provider(*rest) for name, *rest in SOURCES} | {"docs": lambda s, d, q: search.keyword(read(s, d, "documents"), ["text"], q).select(F.col("doc_id").alias("id"), (F.col("score") * 0.8).alias("score"))}
FEDERATED = " UNION ALL ".join(
    [f"(SELECT DISTINCT '{name}' AS provider, {key} AS id, {score}::DOUBLE AS score FROM {table} WHERE contains({text}, '12') ORDER BY 2 LIMIT 3)" for name, table, key, text, score in SOURCES]
    + ["(SELECT 'docs' AS provider, doc_id AS id, round(least(1.0, 0.3 + 0.1 * ((length(text) - length(replace(text, '12', ''))) // 2)), 6) * 0.8 AS score FROM documents WHERE contains(text, '12') ORDER BY 3 DESC, 2 LIMIT 3)"]
)


@Q(f"SELECT *, row_number() OVER (ORDER BY score DESC, provider, id) AS position FROM ({FEDERATED})")
def federated_search(spark: SparkSession, d: str) -> DataFrame:
    return search.federated(spark, d, "12", PROVIDERS, limit=48)


@Q("SELECT page_id, CASE WHEN contains(url, 'page') THEN 0.6 WHEN contains(html, 'page') THEN 0.7 ELSE 1.0 END::DOUBLE AS score FROM pages")
def filesystem_provider(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.when(F.col("url").contains("page"), 0.6).when(F.col("html").contains("page"), 0.7).otherwise(1.0).alias("score"))


@Q("SELECT source AS repository, count(*) AS hits FROM documents WHERE contains(lower(text), 'tion') GROUP BY 1")
def cross_repository_search(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.lower("text").contains("tion")).groupBy(F.col("source").alias("repository")).agg(F.count("*").alias("hits"))


@Q("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n, regexp_extract(line, '([Ll]icense[a-z]*)', 1) AS hit FROM l WHERE regexp_matches(line, '[Ll]icense[a-z]*')")
def content_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.content_matches(read(spark, d, "documents"), "[Ll]icense[a-z]*")


@Q("SELECT doc_id, sha256(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked FROM documents")
def content_replace(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace("text", "[0-9]+", "#"), 256).alias("masked"))


def _intent_sql() -> str:
    q = "trim(text, E' \\t\\n\\r\\x0b\\x0c')"
    score = lambda triggers: "greatest(" + ", ".join(f"least(1.0::DOUBLE, 2.0 * length(regexp_extract(q, '(?i){t}')) / greatest(length(q), 1))" for t in triggers) + ")"
    scores = ", ".join(f"{score(t)} AS s{k}" for k, t in enumerate(search.INTENTS.values()))
    best = "greatest(" + ", ".join(f"s{k}" for k in range(len(search.INTENTS))) + ")"
    names = " ".join(f"WHEN s{k} = best THEN '{name}'" for k, name in enumerate(search.INTENTS))
    other = f"regexp_matches(q, '(?i){'|'.join(search.NON_CODE)}')"
    return f"""WITH t AS (SELECT conv_id, turn, {q} AS q FROM conversations), s AS (SELECT *, {scores} FROM t), b AS (SELECT *, {best} AS best FROM s)
SELECT conv_id, turn, CASE WHEN q = '' THEN 'find_code' WHEN {other} THEN 'non_code' WHEN best < 0.15 THEN 'find_code' {names} END AS intent,
round(CASE WHEN q = '' THEN 0 WHEN {other} THEN 0.9 WHEN best < 0.15 THEN 0.3 ELSE best END, 6) AS confidence FROM b"""


@Q(_intent_sql())
def intent_classification(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns of conversations are the queries."""
    return search.intent(read(spark, d, "conversations"), "text").select("conv_id", "turn", "intent", "confidence")


@Q("SELECT conv_id, sum((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4)::BIGINT AS score FROM conversations GROUP BY 1 HAVING score > 0 ORDER BY 2 DESC, 1 LIMIT 25")
def conversation_search(spark: SparkSession, d: str) -> DataFrame:
    from basaltiq.functions.text import occurrences

    per = read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(occurrences(F.lower("text"), "tion")).alias("score"))
    return per.where("score > 0").orderBy(F.desc("score"), "conv_id").limit(25)


@Q("SELECT doc_id, floor(length(text) * 0.25 + (length(text) - length(replace(text, ' ', ''))) * 1.3)::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@Q("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
t AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, CASE WHEN x LIKE 'vers%' THEN 'vers*' ELSE x END AS term FROM (SELECT doc_id, w, unnest(w) AS x FROM w)) WHERE term IN ('license', 'vers*', 'password') GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 5) AS score FROM t JOIN f USING (term), s GROUP BY 1""")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from a stored index, with a prefix; the index is made of two segments."""
    docs, index = read(spark, d, "documents"), TextIndex(spark)
    for part in (0, 1):
        index.add(docs.where(F.pmod("doc_id", F.lit(2)) == part), "doc_id", "text")
    return index.search(["license", "vers*", "password"]).withColumnRenamed("doc", "doc_id")

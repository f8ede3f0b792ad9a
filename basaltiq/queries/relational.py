"""Predicates, joins, aggregates and set operations of the relational catalog (P, J, A, U, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltiq.functions.text import glob_to_regex
from basaltiq.operators import incremental, relational
from basaltiq.operators.graph import cut
from basaltiq.plans.dsl import compile_query
from basaltiq.registry import CORE
from basaltiq.sources.tables import call_edges, call_edges_sql, file_commits, read

Q = CORE.query

#: Calls of a written part: their keys fit into a column's dictionary, so each call is one run of it.
CALLS_OF_A_PART = 100_000
#: Names beyond that many are not broadcast, and meet their calls in so many shares.
BROADCAST_ROWS, NAME_SHARES = 500_000, 8

FIELDS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@Q("SELECT p_partkey, p_name FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size BETWEEN 5 AND 20 AND p_retailprice >= 905")
def range_and_in_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD") & F.col("p_size").between(5, 20) & (F.col("p_retailprice") >= 905)).select("p_partkey", "p_name")


DSL = {"and": [{"or": [{"field": "p_brand", "op": "glob", "value": "Brand#[12]?"}, {"field": "p_size", "op": ">", "value": 45}]}, {"not": {"field": "p_name", "op": "like", "value": "%1%"}}, {"field": "nonsense", "op": "=", "value": 1}]}


@Q("SELECT p_partkey FROM part WHERE (p_brand SIMILAR TO 'Brand#[12].' OR p_size > 45) AND NOT (p_name ILIKE '%1%')")
def structured_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(compile_query(DSL, FIELDS)).select("p_partkey")


@Q("SELECT c_custkey FROM customer WHERE c_name ILIKE 'CUSTOMER%7'")
def like_ignores_case(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").where(F.col("c_name").ilike("CUSTOMER%7")).select("c_custkey")


@Q("SELECT page_id, url FROM pages WHERE url GLOB 'http*example*/[de]*'")
def glob_on_path(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").where(F.col("url").rlike(glob_to_regex("http*example*/[de]*"))).select("page_id", "url")


@Q("SELECT page_id FROM pages WHERE regexp_matches(url, '[?]page=[0-9]+')")
def regexp_on_path(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").where(F.col("url").rlike("[?]page=[0-9]+")).select("page_id")


@Q("SELECT doc_id FROM documents WHERE regexp_matches(lower(concat_ws(' ', source, lang, text)), 'the.*and')")
def wildcard_over_fields(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.lower(F.concat_ws(" ", "source", "lang", "text")).rlike("the.*and")).select("doc_id")


@Q("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0")
def soft_delete_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0).select("doc_id")


@Q("SELECT event_id, event_type FROM events WHERE CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END >= 3")
def severity_threshold(spark: SparkSession, d: str) -> DataFrame:
    return relational.severity_at_least(read(spark, d, "events"), "event_type", {"error": 4, "purchase": 3, "signup": 2}, 3).select("event_id", "event_type")


@Q("SELECT doc_id, lang, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND n_chars >= 500")
def result_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("source").isin("src1", "src2") & (F.col("lang") == "en") & (F.col("n_chars") >= 500)).select("doc_id", "lang", "source")


@Q("SELECT o_custkey AS custkey FROM orders GROUP BY 1 HAVING list_contains(list(o_orderpriority), '1-URGENT')")
def array_membership(spark: SparkSession, d: str) -> DataFrame:
    tagged = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.collect_set("o_orderpriority").alias("tags"))
    return tagged.where(F.array_contains("tags", "1-URGENT")).select("custkey")


@Q("SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").where(F.col("url").startswith("https://")).select("page_id")


@Q("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 26")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return relational.keyset_page(read(spark, d, "orders"), "o_orderkey", 500, 25).select("o_orderkey", "o_totalprice")


@Q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


# ------------------------------------------------------------------ joins


@Q("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def symbol_file_directory(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@Q("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def symbol_left_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer"), read(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@Q(f"WITH {call_edges_sql()} SELECT a.p_name AS caller, b.p_name AS callee, weight FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE weight >= 2")
def caller_and_callee_names(spark: SparkSession, d: str) -> DataFrame:
    e, p = call_edges(spark, d).where("weight >= 2"), read(spark, d, "part")
    return e.join(p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("caller")), "src").join(p.select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("callee")), "dst").select("caller", "callee", "weight")


@Q("""SELECT cn.n_name AS source_module, sn.n_name AS target_module, count(*) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_nationkey <> sn.n_nationkey GROUP BY 1, 2""")
def module_dependencies(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, s, n = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    # Both ends are reduced to nation keys and counted before names are joined, so names never cross a shuffle.
    ends = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = ends.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = ends.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("weight"))
    named = counted.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source_module")), "c_nationkey")
    return named.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target_module")), "s_nationkey").select("source_module", "target_module", "weight")


@Q(f"WITH {call_edges_sql()} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges)")
def uncalled_functions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").join(call_edges(spark, d), F.col("p_partkey") == F.col("dst"), "left_anti").select("p_partkey")


@Q("""WITH fc AS (SELECT DISTINCT l_orderkey c, l_partkey f FROM lineitem)
SELECT a.f AS file_a, b.f AS file_b, count(*) AS together FROM fc a JOIN fc b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2""")
def pair_self_join(spark: SparkSession, d: str) -> DataFrame:
    return relational.pairs_within(cut(file_commits(spark, d)), "commit", "file", least=2)


@Q("""SELECT c_custkey, coalesce(c_mktsegment, c_name) AS segment, n_name AS workspace, r_name AS ide FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def conversations_with_workspaces(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = read(spark, d, "customer"), read(spark, d, "nation"), read(spark, d, "region").where("r_regionkey < 3")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", F.coalesce("c_mktsegment", "c_name").alias("segment"), F.col("n_name").alias("workspace"), F.col("r_name").alias("ide"))


@Q("SELECT conv_id, turn, source FROM conversations JOIN documents ON conv_id = doc_id WHERE contains(lower(conversations.text), 'tion')")
def message_keyword_join(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "conversations").where(F.lower("text").contains("tion")).select("conv_id", "turn")
    return m.join(read(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source"), "conv_id")


@Q("""SELECT r_name, count(DISTINCT l_partkey) AS parts, count(*) AS uses FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def blast_radius_join(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n, r = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    hot = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey")
    j = li.select("l_orderkey", "l_partkey").join(hot, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.countDistinct("l_partkey").alias("parts"), F.count("*").alias("uses"))


@Q("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").join(read(spark, d, "lineitem").where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@Q("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def optional_match(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@Q("""SELECT a.event_id AS earlier, b.event_id AS later FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE""")
def timeline_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relational.within(read(spark, d, "events"), "user_id", "ts", "event_id", minutes=30)


@Q("""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark)
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (w) GROUP BY 1, 2 HAVING count(*) >= 2""")
def token_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents against benchmark items, two types of chunk, on all their words of four letters or more."""
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1))).alias("w"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    tasks = max(spark.sparkContext.defaultParallelism, -(-docs.count() // 5000))
    return relational.shared_tokens(words(docs.repartition(tasks, "doc_id"), "doc_id"), words(read(spark, d, "benchmark"), "item_id"), "w", "doc_id", "item_id", least=2)


@Q("SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
def cross_with_condition(spark: SparkSession, d: str) -> DataFrame:
    """A small fixed rule table against another: the sizes are those of the rules."""
    return read(spark, d, "region").crossJoin(read(spark, d, "nation")).where("r_regionkey <> n_regionkey").select("r_name", "n_name")


@Q("""WITH n AS (SELECT p_partkey, p_name || '/' || p_brand AS name FROM part) SELECT o_orderkey AS call_id, t.p_partkey AS target
FROM orders JOIN n AS c ON o_custkey = c.p_partkey JOIN n AS t ON c.name = t.name WHERE t.p_partkey <> c.p_partkey""")
def name_resolution_join(spark: SparkSession, d: str) -> DataFrame:
    """Every call by a name to all symbols of that name but the caller's own. The rows are as many as calls times the symbols of a name. Calls
    are dealt by ranges of names and sorted, so that a written part holds few names, one name's targets follow each other as often as it
    is called, and both columns compress; ranges also part the calls of one frequent name. Parts follow the calls, as their rows
    are many. With more names than are broadcast, names meet their calls in ``NAME_SHARES`` shares of each name."""
    names = read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("/"), "p_brand").alias("name"))
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("own"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // CALLS_OF_A_PART))
    calls, order = orders.join(names.select(F.col("p_partkey").alias("own"), "name"), "own"), ["name", "own", "o_orderkey"]
    if names.count() <= BROADCAST_ROWS:
        # Joins ask for no order, so a sort below one is dropped; a condition on the part, which always holds, keeps it.
        calls = calls.repartitionByRange(parts, *order).sortWithinPartitions(*order).where(F.spark_partition_id() >= 0)
        found = calls.join(F.broadcast(names), "name")
    else:
        share = F.pmod(F.xxhash64("own", "o_orderkey"), F.lit(NAME_SHARES)).alias("share")
        spread = names.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NAME_SHARES - 1).cast("long"))))
        found = calls.select("*", share).repartition(parts, "name", "share").hint("merge").join(spread.repartition(parts, "name", "share"), ["name", "share"])
    return found.where("p_partkey <> own").select(F.col("o_orderkey").alias("call_id"), F.col("p_partkey").alias("target"))


@Q("""SELECT l_orderkey AS ref, l_linenumber AS line, CASE WHEN l_suppkey = l_partkey % 100 THEN 1.0 WHEN s_suppkey IS NOT NULL THEN 0.8 WHEN p_partkey IS NOT NULL THEN 0.6 ELSE 0.0 END AS confidence
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN part ON l_partkey = p_partkey""")
def ranked_resolution(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    s, p = read(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"), read(spark, d, "part").select("p_partkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey, "left").join(p, li.l_partkey == p.p_partkey, "left")
    return j.select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("line"), F.when(F.col("l_suppkey") == F.col("l_partkey") % 100, 1.0).when(F.col("s_suppkey").isNotNull(), 0.8).when(F.col("p_partkey").isNotNull(), 0.6).otherwise(0.0).alias("confidence"))


# ------------------------------------------------------------------ aggregates


@Q("SELECT o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1")
def count_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))


@Q("SELECT lang, count(*) AS n, round(avg(CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def conditional_ratio(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("coverage"))


@Q("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 20")
def json_key_group(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(20)


@Q(f"WITH {call_edges_sql()} SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_callees(spark: SparkSession, d: str) -> DataFrame:
    return call_edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(10)


@Q("SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most FROM documents")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@Q("SELECT c_custkey, max(o_orderdate) AS last_order, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def activity_with_zero_rows(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    per = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.count("*").alias("n"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", "last_order", F.coalesce("n", F.lit(0)).alias("n_orders"))


@Q("SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1")
def ingestion_by_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@Q("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_projection(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_brand", "p_type").distinct()


@Q("SELECT lang, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS longest, count(*) AS n FROM documents GROUP BY 1")
def true_p95(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("lang").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("p95"), F.max("n_chars").alias("longest"), F.count("*").alias("n"))


@Q("""SELECT count(*) FILTER (WHERE n_chars < 1000) AS under_1k, count(*) FILTER (WHERE n_chars >= 1000 AND n_chars < 10000) AS under_10k,
count(*) FILTER (WHERE n_chars >= 10000 AND n_chars < 100000) AS under_100k, count(*) FILTER (WHERE n_chars >= 100000) AS larger FROM documents""")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relational.histogram(read(spark, d, "documents"), "n_chars", [("under_1k", 1000), ("under_10k", 10000), ("under_100k", 100000)], "larger")


@Q("SELECT source, sum(n_chars)::BIGINT AS size, round(100.0 * sum(n_chars) / sum(sum(n_chars)) OVER (), 4) AS percent FROM documents GROUP BY 1")
def disk_usage(spark: SparkSession, d: str) -> DataFrame:
    return relational.usage(read(spark, d, "documents"), "source", "n_chars")


@Q("""SELECT CASE WHEN grouping(r_name) = 1 THEN '/' WHEN grouping(n_name) = 1 THEN '/' || r_name ELSE '/' || r_name || '/' || n_name END AS path, count(*) AS entries, round(sum(c_acctbal), 2) AS size
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def directory_rollup(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    files = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("path"), F.col("c_acctbal").alias("size"))
    return relational.directory_rollup(files)


@Q("SELECT CASE WHEN l.doc_id IS NULL THEN 'untracked' WHEN l.toxic = 1 THEN 'ignored' ELSE 'tracked' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def vcs_breakdown(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels").withColumn("has", F.lit(True))
    status = F.when(F.col("has").isNull(), "untracked").when(F.col("toxic") == 1, "ignored").otherwise("tracked")
    return read(spark, d, "documents").join(labels, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@Q("SELECT n_name AS directory, string_agg(s_name, ',' ORDER BY s_name) AS files, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def codemap(spark: SparkSession, d: str) -> DataFrame:
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("directory")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("files"), F.count("*").alias("n"))


@Q("""WITH s AS (SELECT source, count(*) FILTER (WHERE toxic = 1 AND quality = 0) c, count(*) FILTER (WHERE toxic = 1 AND quality = 1) h, count(*) FILTER (WHERE toxic = 0 AND quality = 0) m, count(*) FILTER (WHERE toxic = 0 AND quality = 1) l
FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, c AS critical, h AS high, m AS medium, l AS low, greatest(0, least(100, 100 - 15 * c - 10 * h - 5 * m - 2 * l))::BIGINT AS score FROM s""")
def compliance_score(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    severity = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, "critical").otherwise("high")).when(F.col("quality") == 0, "medium").otherwise("low")
    return relational.compliance(j.select("source", severity.alias("severity")), "source")


# ------------------------------------------------------------------ sets and writes


@Q("SELECT 'customer' AS provider, c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal > 9000")
def union_of_providers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_acctbal > 9000").select(F.lit("customer").alias("provider"), F.col("c_custkey").alias("id"))
    return c.unionByName(read(spark, d, "supplier").where("s_acctbal > 9000").select(F.lit("supplier").alias("provider"), F.col("s_suppkey").alias("id")))


@Q("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@Q("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")))


@Q("""SELECT d.doc_id, 'contained' AS kind FROM documents d JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'orphaned' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def contained_and_orphaned(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.lit("contained").alias("kind")).join(labels, "doc_id", "left_semi").unionByName(docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("orphaned").alias("kind")))


@Q("""WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS v, 1 AS ver FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, o_orderstatus || '!', 2 FROM orders WHERE o_orderkey % 2 = 0),
u AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT k, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY ver DESC) = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.concat("o_orderstatus", F.lit("!")).alias("v"))
    return incremental.upsert(old, new, ["k"])


@Q("SELECT p_partkey AS k, 'old' AS v FROM part WHERE p_size < 25 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size >= 25")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return incremental.insert_absent(p.where("p_size < 25").select(F.col("p_partkey").alias("k"), F.lit("old").alias("v")), p.select(F.col("p_partkey").alias("k"), F.lit("new").alias("v")), ["k"])


@Q("SELECT l_suppkey AS src, l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2")
def weighted_edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1.0).alias("weight"))
    return incremental.accumulate(li.where("src % 2 = 0"), li.where("src % 2 <> 0"), ["src", "dst"], "weight")


@Q("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    new = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return incremental.changes(old, new, ["k"]).where("change <> 'same'").select("k", "change")


@Q("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def orphan_compaction(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    kept = incremental.without_orphans(li, "l_suppkey", read(spark, d, "supplier").where("s_acctbal < 0"), "s_suppkey")
    return incremental.without_orphans(kept, "l_orderkey", read(spark, d, "orders"), "o_orderkey").select("l_orderkey", "l_partkey")


@Q("SELECT id, name FROM (SELECT s_suppkey AS id, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r = 1")
def graph_node_merge(spark: SparkSession, d: str) -> DataFrame:
    return incremental.first_seen(read(spark, d, "supplier"), ["s_nationkey"], "s_suppkey").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@Q("SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n, grouping(c_nationkey) + 2 * grouping(c_mktsegment) AS level FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    named = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    cubed = named.cube("nation", "segment")
    return cubed.agg(F.count("*").alias("n"), (F.grouping("nation") + 2 * F.grouping("segment")).cast("long").alias("level"))


@Q("SELECT column_name, n, lo, hi, round(mean, 4) AS mean FROM (SELECT 'p_size' AS column_name, count(p_size) AS n, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, avg(p_size) AS mean FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice), min(p_retailprice), max(p_retailprice), avg(p_retailprice) FROM part)")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return relational.profile(read(spark, d, "part"), ["p_size", "p_retailprice"])


@Q("SELECT doc_id, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS place FROM documents QUALIFY place <= 3")
def largest_per_source(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"))
    return read(spark, d, "documents").select("doc_id", F.rank().over(w).cast("long").alias("place")).where("place <= 3")

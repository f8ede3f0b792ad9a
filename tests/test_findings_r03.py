"""Findings of round 3: what would have failed before."""

import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from basaltiq.llm import quality_rules
from basaltiq.operators import callgraph, code, communities, extract, graph, patterns, relational, search
from basaltiq.operators.textindex import TextIndex
from basaltiq.registry import load_core
from tests.oracle import same

CORE = load_core()
SF = "/root/testdata/sf0.01"


def test_calls_of_a_name_stand_together(spark, tmp_path):
    for table, files in (("part", 1), ("orders", 8)):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(files).write.parquet(f"{tmp_path}/{table}.parquet")
    names = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").alias("target"), F.concat_ws("/", "p_name", "p_brand").alias("name"))
    rows = CORE.builders["name_resolution_join"](spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).join(names, "target")
    got = rows.agg(F.countDistinct("part", "name").alias("runs"), F.countDistinct("name").alias("names"), F.countDistinct("part").alias("parts")).first()
    assert got.parts > 1 and got.runs < got.names + got.parts


def test_events_after_the_last_day_are_not_lost(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
    rows = [(1, 5, 0, "I", at(3, 1), "web", "a", "b", 1.0), (2, 5, 1, "U", at(900, 1), "web", "a", "b", 1.0), (3, 6, 0, "I", at(1500, 2), "web", "a", "c", 1.0), (4, 6, 1, "D", at(2900, 2), "web", "a", "c", 1.0)]
    schema = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/client_changes.parquet")
    assert same(CORE.builders["change_events"](spark, str(tmp_path)), CORE.sql["change_events"], str(tmp_path)) == 4


#: A text that each pattern matches, in another case where case does not count.
SAMPLES = {
    "private_key": "-----BEGIN RSA PRIVATE KEY-----", "ssh_private_key": "-----BEGIN OPENSSH PRIVATE KEY-----", "pgp_private_key": "-----BEGIN PGP PRIVATE KEY BLOCK-----",
    "github_token": "GHS_" + "a" * 30, "jwt": "eyJ" + ".".join(["a" * 12] * 3), "slack_token": "XOXB-1234567890", "stripe_live": "PK_live_1234567890", "bearer_hardcoded": "BEARER " + "a" * 20,
    "docker_auth": '"auth": "' + "a" * 20 + '"', "pg_conn": "POSTGRES://a:b@c", "mysql_conn": "MYSQL://a:b@c", "mongodb_conn": "MongoDB+srv://a:b@c", "redis_conn": "REDIS://:b@c", "jdbc_url": "JDBC:x://a:b@",
    "aws_key": "akia" + "a" * 16, "gcp_key": '"private_key_id": "' + "a" * 20 + '"', "azure_key": "Azure_" + "a" * 20, "gitlab_token": "GLPAT-:" + "a" * 10, "stripe_test": "SK_TEST_1234567890",
    "firebase_key": "AIZA1234567890", "telegram_bot": "12345678:" + "a" * 30, "slack_webhook": "HTTP://hooks.SLACK.com/services/" + "a" * 20, "twilio_key": "sK" + "a" * 32, "cloudflare_api": "CF_api=" + "a" * 20,
    "password": "PWD='abcd'", "api_key": "API-secret=" + "a" * 16, "generic_secret": "Encryption_Key='" + "a" * 16 + "'", "github_old_token": "GitHub_token=" + "a" * 20, "discord_token": "DISCORD_bot_token=" + "a" * 20,
    "email_creds": "IMAP_password='a'", "npm_token": "_AUTHTOKEN='" + "a" * 20 + "'", "heroku_api": "HEROKU_api_key=" + "a" * 20, "sonar_token": "SonarQube_token=" + "a" * 20, "datadog_key": "dd_API_key=" + "a" * 20,
    "newrelic_key": "NEW_relic=" + "a" * 20, "sendgrid_key": "SendGrid_api_key=" + "a" * 20, "mailgun_key": "MAILGUN_api=" + "a" * 20, "s3_creds": "S3_secret_key", "ssn": "123-45-6789",
    "credit_card": "1234 5678-9012 3456", "ip_private": "172.16.1.2",
}


def test_what_patterns_hold(spark):
    """The literals that are looked for first exclude no match, and a text without any meets no pattern."""
    assert set(SAMPLES) == set(code.HELD) == {n for n, _, _ in code.SENSITIVE}
    docs = spark.createDataFrame([(n, f"İ {t} é") for n, t in SAMPLES.items()] + [("none", "plain words only"), ("null", None)], "doc_id string, text string")
    got = {(r.doc_id, r.name) for r in code.sensitive(docs, "doc_id", "text").collect()}
    want = {(n, k) for n, t in SAMPLES.items() for k, _, p in code.SENSITIVE if re.search(p, f"İ {t} é")}
    assert got == want and {(n, n) for n in SAMPLES} <= got
    shown = {r.doc_id: (r.action, r.text) for r in code.filtered(docs, "doc_id", "text").collect()}
    for n, t in SAMPLES.items():
        text = f"İ {t} é"
        for _, _, p in code.SENSITIVE:
            text = re.sub(p, code.PLACEHOLDER, text)
        assert shown[n] == ("mask", text)
    assert shown["none"] == ("allow", "plain words only") and shown["null"] == ("allow", None)


def test_entropy_deals_rows_before_it_counts(spark, tmp_path):
    """A table of one file: the counts for each character are made in more than one task."""
    rows = spark.range(40_000).select(F.col("id").alias("p_partkey"), F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1)
    rows.write.parquet(f"{tmp_path}/rows")
    plan = extract.entropy(spark.read.parquet(f"{tmp_path}/rows"), "p_partkey", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning(p_partkey") > plan.rindex("partial_count(1)")


def test_pairs_are_made_in_tasks_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(relational, "TASK_ROWS", 100)
    df = spark.range(4000).select((F.col("id") % 1000).alias("g"), F.col("id").alias("i")).localCheckpoint()
    pairs = relational.pairs_within(df, "g", "i")
    assert "hashpartitioning(g" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and ", 40)" in plan
    assert pairs.count() == 6000


def test_vectors_are_scored_in_bounded_steps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [tuple(r) for r in search.nearest(v, v.where("vec_id % 20 = 0"), 5).orderBy("query", F.desc("score"), "vec_id").collect()]
    monkeypatch.setattr(search, "CELLS", 15 * 7)
    assert [tuple(r) for r in search.nearest(v, v.where("vec_id % 20 = 0"), 5).orderBy("query", F.desc("score"), "vec_id").collect()] == whole
    assert len(whole) == 75 and all(r[0] == whole[k - k % 5][0] for k, r in enumerate(whole))


def test_anchors_are_sought_in_words_not_in_texts(spark, monkeypatch):
    scanned, grams = [], patterns._grams
    monkeypatch.setattr(patterns, "_grams", lambda text, n: scanned.append(str(text)) or grams(text, n))
    texts = spark.createDataFrame([(1, "an  unlucky\tday"), (2, "lucky day"), (3, "luck y day"), (4, ""), (5, None), (6, "x-ab")], "id long, text string")
    names = spark.createDataFrame([("lucky",), ("lucky day",), ("ab",), ("y d",), (" ",), ("day",)], "name string")
    got = {tuple(r) for r in patterns.mentions(texts, names).collect()}
    plain = {(t.id, n.name) for t in texts.collect() for n in names.collect() if n.name.strip() and n.name in (t.text or "")}
    assert got == plain and scanned and not any("text" in c for c in scanned)


def test_buckets_are_counted_by_as_many_tasks_as_run(spark):
    """A bucket is sent once by each task that meets it, so pieces of the input beyond the cores send nothing more."""
    rows = [(k, f"the word{k % 7} and word{k % 5}", 1 if k % 2 else None) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trusted int").repartition(40)
    found = quality_rules._counts(docs, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(") < plan.index("partial_count(1)") < plan.index(f"Coalesce {spark.sparkContext.defaultParallelism}")
    total = found.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    assert (total.raw, total.target) == (200 * 7, 100 * 7) and found.count() <= 16


def test_a_round_of_moves_writes_two_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(communities, "cut", lambda df: written.append(df.columns) or graph.cut(df))
    edges = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0)]
    adjacent = spark.createDataFrame(edges, "a long, b long, w double")
    own = spark.createDataFrame([(0, 1.0, 0.0, 0), (1, 2.0, 0.0, 0), (2, 1.0, 0.0, 0), (3, 1.0, 0.0, 3), (4, 1.0, 0.0, 4)], "v long, k double, loop double, c long")
    state = communities._State(own, adjacent, 6.0)
    assert len(written) == 1 and abs(state.modularity - (4 / 6 - (4 / 6) ** 2 - 2 / 36)) < 1e-12
    assert {(r.v, r.to, round(r.gain, 12)) for r in communities._gains(state, 6.0).where("to is not null").collect()} == {(3, 4, round(2 * (1 - 1 / 6) / 6, 12)), (4, 3, round(2 * (1 - 1 / 6) / 6, 12))}


def test_levels_of_betweenness_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(callgraph, "cut", lambda df: written.append(df.columns) or graph.cut(df))
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4), (4, 2)], "src long, dst long")
    got = {r.id: r.score for r in callgraph.betweenness(edges).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 3.0, 3: 0.0, 4: 1.0}
    assert ["s", "id"] not in written


def test_an_index_counts_words_where_the_texts_were_dealt(spark, monkeypatch):
    """The texts are dealt once; no row of a word is shuffled before it is counted, and words and stems come from one pass."""
    plans, publish = [], TextIndex._publish
    monkeypatch.setattr(TextIndex, "_publish", lambda self, postings, *rest: (plans.append(postings._jdf.queryExecution().executedPlan().toString()), publish(self, postings, *rest)))
    docs = spark.createDataFrame([(1, "Cats and cats"), (2, "cat"), (3, None), (4, "")], "id long, text string")
    index = TextIndex(spark)
    index.add(docs, "id", "text")
    assert plans[0].count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc" in plans[0]
    assert index._sizes().first() == (4, 4)
    assert {(r.doc, r.tf, r.len) for r in index.postings(["cat"], kind="stem").collect()} == {(1, 2, 3), (2, 1, 1)}
    assert {(r.doc, r.tf, r.len) for r in index.postings(["cats"]).collect()} == {(1, 2, 3)}


def test_shared_words_are_counted_where_the_texts_were_dealt(spark, monkeypatch):
    """No pair is shuffled when the right table is small; the way for large ones gives the same pairs."""
    left = spark.range(300).select((F.col("id") % 60).alias("a"), (F.col("id") * 7 % 11).alias("w")).distinct().repartition(4, "a").localCheckpoint().repartition(4, "a")
    right = spark.range(200).select(F.when(F.col("id") % 20 > 0, F.col("id") % 20).alias("b"), (F.col("id") * 3 % 13).alias("w")).distinct()
    found = relational.shared_tokens(left, right, "w", "a", "b", least=2)
    assert "hashpartitioning(a" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(a#" in plan and not re.search(r"hashpartitioning\(a#\d+L?, b", plan)
    small = sorted(map(str, found.collect()))
    monkeypatch.setattr(relational, "MOST_LARGE", 0)
    assert sorted(map(str, relational.shared_tokens(left, right, "w", "a", "b", least=2).collect())) == small and len(small) > 100


def test_blocks_derive_the_lines_of_a_file_once(spark, tmp_path):
    """The windows and counts of a block need one shuffle of the lines' table and no join."""
    plan = CORE.builders["structure_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and not re.search("(Merge|Hash|Loop)Join", plan) and plan.count("FileScan parquet") == 1

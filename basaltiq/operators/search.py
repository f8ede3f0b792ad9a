"""Text search modes, ranking and federation. Every provider gives rows of one schema; one window ranks them."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltiq.functions.text import glob_to_regex, occurrences, snippet, words
from basaltiq.plans.dsl import boolean_column, detect_mode, parse_boolean, safe_pattern


def hit_score(text: Column, keyword: str, *, base: float = 0.3, step: float = 0.1) -> Column:
    n = occurrences(F.lower(text), keyword.lower())
    return F.when(n > 0, F.least(F.lit(1.0), base + step * n)).otherwise(0.0)


def keyword(df: DataFrame, fields: list[str], word: str) -> DataFrame:
    """All columns and ``score``: the mean over fields of their hit scores, at most 1."""
    total = reduce(lambda a, b: a + b, [hit_score(F.coalesce(F.col(f), F.lit("")), word) for f in fields])
    return df.withColumn("score", F.round(F.least(F.lit(1.0), total / len(fields)), 6)).where("score > 0")


def regex(df: DataFrame, field: str, pattern: str) -> DataFrame:
    n = F.regexp_count(F.col(field), F.lit(safe_pattern(pattern)))
    return df.withColumn("score", F.round(F.least(F.lit(1.0), 0.3 + 0.15 * n), 6)).where(n > 0)


def glob(df: DataFrame, field: str, pattern: str) -> DataFrame:
    return df.where(F.lower(F.col(field)).rlike(glob_to_regex(pattern.lower()))).withColumn("score", F.lit(1.0))


def boolean(df: DataFrame, field: str, query: str) -> DataFrame:
    tree = parse_boolean(query)
    score = 0.7 if "not" in tree else 1.0 if "and" in tree or "term" in tree else 0.9
    return df.where(boolean_column(F.col(field), tree)).withColumn("score", F.lit(score))


def fuzzy(df: DataFrame, field: str, word: str, threshold: float = 0.6) -> DataFrame:
    """Similarity of the whole field to the word by longest matching blocks; Arrow batches, since no built-in does it."""

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        match = difflib.SequenceMatcher(autojunk=False)
        match.set_seq2(word.lower())

        def one(t: str | None) -> float:
            match.set_seq1((t or "").lower())
            return match.ratio() if match.real_quick_ratio() >= threshold and match.quick_ratio() >= threshold else 0.0

        return texts.map(one)

    # No text beyond these bounds can reach the threshold; only the others leave the JVM.
    n, own = F.length(F.lower(F.col(field))), word.lower()
    text = F.lower(F.col(field))
    common = reduce(lambda x, y: x + y, [F.least(n - F.length(F.replace(text, F.lit(c), F.lit(""))), F.lit(own.count(c))) for c in sorted(set(own))], F.lit(0))
    near = df.where(2 * F.least(n, F.lit(len(own))) >= threshold * (n + len(own))).where(2 * common >= threshold * (n + len(own)))
    return near.withColumn("score", ratio(F.col(field))).where(F.col("score") >= threshold)


def search(df: DataFrame, query: str, field: str) -> DataFrame:
    """The mode that the query's form asks for."""
    mode, _, pattern = detect_mode(query)
    modes: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"regex": regex, "glob": glob, "boolean": boolean, "fuzzy": fuzzy}
    return modes[mode](df, field, pattern) if mode in modes else keyword(df, [field], pattern)


def bm25(docs: DataFrame, ident: str, text: str, terms: list[str], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``ident, score`` for documents with a term. Term counts come from one pass; the shuffle has one row a document and term."""
    asked = [t.lower() for t in terms]
    own = docs.select(ident, words(F.col(text)).alias("w")).select(ident, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(asked)).alias("w"))
    stats = own.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"))
    tf = own.select(ident, "len", F.explode("w").alias("term")).groupBy(ident, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    j = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return j.groupBy(ident).agg(F.round(F.sum(part), 5).alias("score"))


#: Scores that a task holds at once, 8 bytes each and a few copies.
CELLS = 1_000_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 2048) -> DataFrame:
    """``query, vec_id, score``: the k most similar vectors to each query vector, by cosine, exact.

    Queries go out in blocks of ``block``; each block is one pass in which every task keeps the best k of each query, so what
    is shuffled is k rows a query and task. The driver holds one block.
    """
    parts = max(1, -(-queries.count() // block))
    found = [_nearest_block(vectors, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i), k) for i in range(parts)]
    merged = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _nearest_block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select("vec_id", "embedding").collect()
    if not rows:
        return vectors.select(F.col("vec_id").cast("long").alias("query"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    ids, target = [r["vec_id"] for r in rows], _unit(np.array([r["embedding"] for r in rows], float))
    step = max(1, CELLS // len(ids))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for b in (all_.iloc[at : at + step] for all_ in batches for at in range(0, len(all_), step)):
            raw = _unit(np.array(b["embedding"].tolist(), float)) @ target.T
            score = np.copysign(np.floor(np.abs(raw) * 1e4 + 0.5), raw).T / 1e4
            score = np.concatenate([held[0], score], axis=1)
            vec = np.concatenate([held[1], np.broadcast_to(b["vec_id"].to_numpy(np.int64), (len(ids), len(b)))], axis=1)
            order = np.lexsort((vec, -score), axis=1)[:, :k]
            held = np.take_along_axis(score, order, axis=1), np.take_along_axis(vec, order, axis=1)
        yield pd.DataFrame({"query": np.repeat(np.array(ids, np.int64), held[0].shape[1]), "vec_id": held[1].ravel(), "score": held[0].ravel() + 0.0})

    return vectors.select("vec_id", "embedding").mapInPandas(best, "query long, vec_id long, score double")


def hashed_vector(docs: DataFrame, ident: str, text: str, dim: int = 128) -> DataFrame:
    """``ident, bucket, weight``: L2-normalised word counts by a stable hash bucket (first eight digits of MD5)."""
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % dim
    own = docs.select(ident, F.explode(words(F.col(text))).alias("word")).groupBy(ident, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # A document's counts, at most ``dim``, come together in its row: no join with the norms.
    rows = own.groupBy(ident).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.collect_list(F.struct("bucket", "n")).alias("counts"))
    return rows.select(ident, "norm", F.explode("counts").alias("c")).select(ident, "c.bucket", F.round(F.col("c.n") / F.col("norm"), 6).alias("weight"))


def fuzzy_names(df: DataFrame, name: str, word: str, distance: int) -> DataFrame:
    """Names within an edit distance, as they are or without separators and case."""
    plain = lambda c: F.lower(F.translate(c, "_- #", ""))
    raw = F.levenshtein(F.col(name), F.lit(word), distance)
    bare = F.levenshtein(plain(F.col(name)), plain(F.lit(word)), distance)
    return df.where((raw >= 0) | (bare >= 0))


def task_overlap(df: DataFrame, text: str, task: str) -> DataFrame:
    asked = F.array_distinct(F.filter(words(F.lit(task)), lambda w: F.length(w) >= 4))
    own = F.array_distinct(F.filter(words(F.col(text)), lambda w: F.length(w) >= 4))
    return df.withColumn("overlap", F.round(F.size(F.array_intersect(own, asked)) / F.greatest(F.size(own), F.size(asked), F.lit(1)), 6))


def precision(text: Column, phrase: str) -> Column:
    """1 for the phrase, .8 for all its words, .3 and up to .4 more for some."""
    parts = phrase.lower().split()
    has = [F.when(F.lower(text).contains(p), 1).otherwise(0) for p in parts]
    n = reduce(lambda a, b: a + b, has)
    return F.when(F.lower(text).contains(phrase.lower()), 1.0).when(n == len(parts), 0.8).when(n > 0, 0.3 + 0.4 * n / len(parts)).otherwise(0.0)


WEIGHTS = {"fts": 0.30, "semantic": 0.25, "graph": 0.20, "freshness": 0.10, "precision": 0.15}


def composite(df: DataFrame, *, least: float = 0.05, k: int = 50) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in WEIGHTS.items()])
    return df.withColumn("score", F.round(total, 6)).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


Provider = Callable[[SparkSession, str, str], DataFrame]


def federated(spark: SparkSession, sf_dir: str, query: str, providers: dict[str, Provider], *, limit: int) -> DataFrame:
    """``provider, id, score, position``: each provider's best, merged by score. Each gives at most its share."""
    share = max(1, limit // len(providers))
    parts = [p(spark, sf_dir, query).select(F.lit(name).alias("provider"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(share) for name, p in providers.items()]
    merged = reduce(DataFrame.unionByName, parts)
    w = Window.orderBy(F.desc("score"), "provider", "id")
    return merged.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= limit)


#: Triggers of each intent, and words of queries that are not about code.
INTENTS = {
    "trace_bug": ["trace", "flow", "execution path", "call chain", "how does.*work", "where.*crash", "why.*fail", "debug", "stack trace", "error path"],
    "understand_feature": ["how does", "explain", "overview of", "understand", "what does.*do", "architecture of", "design of", "structure of"],
    "find_usage": ["called by", "used in", "used by", "referenced by", "imported by", "where is", "where are", "find usages", "find callers", "find callees", "who calls", "who uses", "who imports"],
    "check_impact": ["impact", "what breaks", "change.*affect", "modify.*effect", "rename.*impact", "refactor.*risk", "blast radius", "before.*change", "safe to.*(change|delete|remove|rename)"],
    "architecture_overview": ["architecture", "module", "dependency", "overview", "component", "layer", "boundary", "service.*map", "system.*design", "how.*organize", "project structure"],
    "find_code": ["find", "search", "locate", "where is", "show me", "look for", "get the.*(file|class|function|method)"],
    "explain_error": ["error", "exception", "traceback", "crash log", "stack trace", "failed", "broken", "not working", "bug report"],
}
NON_CODE = ["weather", "news", "sports", "movie", "recipe", "cooking", "hello", "hi there", "how are you", "who are you", "joke", "poem", "story", "song"]


def intent(df: DataFrame, text: str, least: float = 0.15) -> DataFrame:
    """All columns, ``intent`` and ``confidence``: the intent with the longest trigger match, twice its share of the query at most
    1, the first on ties. Below ``least`` it is ``find_code`` at 0.3; a query about something else is ``non_code`` at 0.9."""
    q = F.regexp_replace(F.col(text), r"^[ \t-\r]+|[ \t-\r]+$", "")
    own = df.withColumn("_q", q)
    share = lambda t: F.least(F.lit(1.0), 2.0 * F.length(F.regexp_extract("_q", f"(?i){t}", 0)) / F.greatest(F.length("_q"), F.lit(1)))
    for k, triggers in enumerate(INTENTS.values()):
        own = own.withColumn(f"_s{k}", F.greatest(*map(share, triggers)))
    own = own.withColumn("_best", F.greatest(*(f"_s{k}" for k in range(len(INTENTS)))))
    empty, other, low = F.col("_q") == "", F.col("_q").rlike(f"(?i){'|'.join(NON_CODE)}"), F.col("_best") < least
    name = F.lit("find_code")
    for k, intent_name in reversed(list(enumerate(INTENTS))):
        name = F.when(F.col(f"_s{k}") == F.col("_best"), intent_name).otherwise(name)
    own = own.withColumn("intent", F.when(empty, "find_code").when(other, "non_code").when(low, "find_code").otherwise(name))
    own = own.withColumn("confidence", F.round(F.when(empty, 0.0).when(other, 0.9).when(low, 0.3).otherwise(F.col("_best")), 6))
    return own.drop("_q", "_best", *(f"_s{k}" for k in range(len(INTENTS))))


def content_matches(docs: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, n, hit`` for each line that matches."""
    safe_pattern(pattern)
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike(pattern))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), F.regexp_extract("line", f"({pattern})", 1).alias("hit"))


def snippets(df: DataFrame, text: str, word: str) -> DataFrame:
    return df.withColumn("snippet", snippet(F.col(text), word)).where("snippet is not null")


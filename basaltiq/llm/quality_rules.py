"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Uni- and bigrams of words are hashed into buckets. Two multinomials over the buckets, one of the trusted documents and
one of the whole corpus, each mixed with the uniform one, give every bucket a log ratio; a document's score is the mean
over its n-grams, and one fixed threshold decides. The buckets grow with the distinct n-grams, ``LOAD`` to a bucket, so
that rare n-grams do not drown the ratios of the common ones and one threshold means the same at every size. The model
is a written table, broadcast up to ``MODEL_ROWS`` buckets and joined by shuffle beyond.

Defined results: a null or empty text has no words and fails the base rules; without a trusted document (empty or null
labels) every ratio is 0 and the base rules alone decide; repeated rows are judged each alike and count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import BROADCAST_ROWS, let, sources_of, written

WORD_GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Distinct n-grams a bucket; fewer let n-grams of one document decide, more let collisions hide the marked words.
LOAD = 44
#: Buckets that may be broadcast, as rows of a long and a double.
MODEL_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def _pairs(hashes: Column, n: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` further on; ``n`` elements before, ``n - step`` after."""
    left = F.greatest(n - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, left), F.slice(hashes, step + 1, left), lambda a, b: F.xxhash64(a, b))


def with_gram_hashes(docs: DataFrame, *cols: str) -> DataFrame:
    """The columns ``cols`` of ``docs``, ``words``, and ``g1``, ``g2``: 64-bit hashes of words and of word pairs."""
    words = docs.select(*cols, words_of(F.col("text")).alias("words"))
    one = words.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    return one.withColumn("g2", _pairs(F.col("g1"), F.size("g1"), 1))


def repeat_words(windows: Column, n: Column) -> Column:
    """Words covered by windows of 8 that occur twice or more; ``windows``: a hash for each of ``n`` start positions.

    Most texts end after the hash-set comparison. The others sort (hash, start), so the cost stays n log n.
    """
    ordered = F.sort_array(F.zip_with(windows, F.sequence(F.lit(0), n - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        rest = F.size(p) - 1
        steps = F.zip_with(F.slice(p, 1, rest), F.slice(p, 2, rest), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
        return F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda total, x: total + x)

    return F.when((n > 0) & (F.size(F.array_distinct(windows)) < n), let(let(ordered, twins), covered)).otherwise(F.lit(0).cast("long"))


def with_base_rules(docs: DataFrame, *cols: str) -> DataFrame:
    """``cols``, ``g1``, ``g2`` and the base columns of each text."""
    grams = with_gram_hashes(docs, *dict.fromkeys((*cols, "text")))
    four = grams.withColumn("g4", _pairs(F.col("g2"), F.size("g2"), 2))
    eight = four.withColumn("g8", _pairs(F.col("g4"), F.size("g4"), 4))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(HAS_WORD))
    n = F.size("words").cast("long")
    base = eight.select(
        *cols, "g1", "g2", n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("g8"), F.size("g8")).alias("n_repeat_words"),
    )
    return base.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _grams(docs: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and ``g``: a row for each uni- and bigram of each text."""
    return with_gram_hashes(docs, *cols).select(*cols, F.explode(F.concat("g1", "g2")).alias("g"))


def _counts(docs: DataFrame, n: int) -> DataFrame:
    """``bucket, raw, target`` of ``docs (text, trusted)``. Every task sends a row for each bucket that it has met, most of the ``n`` soon, so texts
    are read by as many tasks as run at once, not by one for each piece of a file: what is sent follows the buckets alone."""
    few = docs.coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism))
    return _grams(few, "trusted").groupBy(F.pmod("g", F.lit(n)).alias("bucket")).agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))


def log_ratios(docs: DataFrame, labels: DataFrame, *, n_buckets: int, uniform: float) -> tuple[DataFrame, int]:
    """The model, ``bucket, ratio``: log p(bucket | trusted) - log p(bucket | corpus), from all rows; and its number of
    buckets, ``n_buckets`` at least. Three totals reach the driver."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    side = F.broadcast(trusted) if trusted.count() <= BROADCAST_ROWS else trusted
    grams = _grams(docs.join(side, "doc_id", "left"), "trusted")
    total = grams.agg(F.approx_count_distinct("g").alias("grams"), F.count("*").alias("raw"), F.count("trusted").alias("target")).first()
    n = max(n_buckets, total["grams"] // LOAD)
    counts = _counts(docs.join(side, "doc_id", "left"), n)
    p = lambda c: F.lit(1 - uniform) * F.col(c) / F.lit(total[c]) + F.lit(uniform / n)
    ratio = F.round(F.log(p("target")) - F.log(p("raw")), 9) if total["target"] else F.lit(0.0)
    return written(counts.select("bucket", ratio.alias("ratio")), "quality_ratios"), n


def scores(docs: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """``text_h1, text_h2, mean``: the mean ratio over the n-grams of each distinct text; copies do not change a mean."""
    side = F.broadcast(model) if n <= MODEL_ROWS else model
    rows = _grams(docs, "text_h1", "text_h2").withColumn("bucket", F.pmod("g", F.lit(n))).join(side, "bucket")
    return written(rows.groupBy("text_h1", "text_h2").agg(F.avg("ratio").alias("mean")), "quality_scores")


def judge(docs: DataFrame, labels: DataFrame, *, n_buckets: int = 8192, uniform: float = 0.1, threshold: float = -0.1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the base columns, ``score`` and ``kept`` for every document, with the columns named in ``keep``."""
    docs = sources_of(docs, *dict.fromkeys(("doc_id", "text", *keep)))
    model, n = log_ratios(docs.select("doc_id", "text"), labels, n_buckets=n_buckets, uniform=uniform)
    docs = docs.withColumns({"text_h1": F.xxhash64("text"), "text_h2": F.xxhash64(F.lit(1), "text")})
    means = scores(docs.select("text", "text_h1", "text_h2"), model, n)
    base = with_base_rules(docs, "doc_id", *[c for c in keep if c != "doc_id"], "text_h1", "text_h2").drop("g1", "g2")
    found = base.join(F.broadcast(means) if means.count() <= BROADCAST_ROWS else means, ["text_h1", "text_h2"], "left").drop("text_h1", "text_h2")
    scored = found.withColumn("score", F.when(F.col("base_failed"), F.lit(None).cast("double")).otherwise(F.round("mean", 6))).drop("mean")
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False)))

"""A stored full-text index: postings by term, prefixes, stems, and segments that are added and merged.

An index is a folder. A segment holds the postings ``(term, doc, tf, len)`` of the texts it was made from, once by word and once
by stem, dealt to ``BUCKETS`` folders by the term's hash and sorted by term within, so a query opens its terms' folders and skips
what lies beside them by the files' statistics. Shares of the documents of a folder are what tasks write: a word of every text is
spread over several. Words are listed under their first 2, 3 and 4 letters. ``live`` lists the segments of each version of the index,
the last one counts; a reader never sees half a merge. Adding a segment beyond ``fan_in`` merges all of them into one, so what
is written grows as the texts times the logarithm of their number. A document's id must not come twice.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.functions.text import words
from basaltiq.operators.graph import cut, shared_folder

BUCKETS = 32
PREFIXES = (2, 3, 4)
#: Documents whose words a task counts, and documents whose postings of one bucket a task writes.
TASK_DOCS, SHARE_DOCS = 2000, 100_000
POSTINGS = "term string, doc long, tf long, len long, kind string, bucket int"
VOWEL = "[aeiouy]"


def stem(word: Column) -> Column:
    """Suffix rules for English words of four letters or more: plurals, -ed and -ing behind a vowel, and a final y."""
    plural = F.when(word.endswith("sses"), F.regexp_replace(word, "sses$", "ss")).when(word.endswith("ies"), F.regexp_replace(word, "ies$", "i")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    bare = F.regexp_replace(plural, "(ed|ing)$", "")
    whole = F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike(r"([^aeioulsz])\1$"), F.regexp_replace(bare, ".$", "")).otherwise(bare)
    cut_ = F.when(plural.endswith("eed"), F.regexp_replace(plural, "eed$", "ee")).when(plural.rlike(f"{VOWEL}.*(ed|ing)$"), whole).otherwise(plural)
    # Words of other last letters are their own stems.
    return F.when((F.length(word) < 4) | ~F.right(word, F.lit(1)).isin("s", "d", "g", "y"), word).otherwise(F.when(cut_.rlike(f"{VOWEL}.*y$"), F.regexp_replace(cut_, "y$", "i")).otherwise(cut_))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """The index in ``path``; without one, in a new folder of the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, fan_in: int = 4) -> None:
        self._spark, self._fan_in = spark, fan_in
        self.path = path or f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"

    # Writing

    def add(self, docs: DataFrame, ident: str, text: str) -> None:
        """A segment of ``docs``; null and empty texts count as documents without words.

        Texts are dealt before they are cut into words, so that words and stems are counted where they stand."""
        n_docs = docs.count()
        tasks = max(self._spark.sparkContext.defaultParallelism, -(-n_docs // TASK_DOCS))
        dealt = docs.select(F.col(ident).alias("doc"), F.col(text).alias("text")).repartition(tasks, "doc")
        own = dealt.select("doc", words(F.coalesce("text", F.lit(""))).alias("w")).select("doc", F.size("w").cast("long").alias("len"), F.explode("w").alias("term"))
        counted = own.groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
        both = counted.select("doc", "len", "tf", F.explode(F.array(F.struct(F.lit("word").alias("kind"), "term"), F.struct(F.lit("stem").alias("kind"), stem(F.col("term")).alias("term")))).alias("t"))
        self._publish(both.groupBy("doc", "len", "t.kind", "t.term").agg(F.sum("tf").alias("tf")), n_docs, self.segments())
        if len(self.segments()) > self._fan_in:
            self.merge()

    def merge(self) -> None:
        """All segments become one; the old ones stay on disk for readers that have begun."""
        both = [self._postings(kind).withColumn("kind", F.lit(kind)) for kind in ("word", "stem")]
        self._publish(both[0].unionByName(both[1]), self._sizes().first().n_docs, [])

    def _publish(self, postings: DataFrame, n_docs: int, beside: list[str]) -> None:
        name = uuid.uuid4().hex
        # A bucket is written by several tasks, a share of the documents each, and a task writes one bucket; nothing is sampled for that.
        shares = max(1, -(-n_docs // SHARE_DOCS))
        dealt = lambda df, key, by: df.withColumn("bucket", _bucket(F.col(key))).repartitionById(BUCKETS * shares, F.col("bucket") * shares + F.pmod(F.xxhash64(by), F.lit(shares)).cast("int"))
        made = dealt(postings.select("term", "doc", "tf", "len", "kind"), "term", "doc")
        made.sortWithinPartitions("kind", "bucket", "term", "doc").write.partitionBy("kind", "bucket").parquet(f"{self.path}/segment-{name}")
        own = self._spark.read.schema(POSTINGS).parquet(f"{self.path}/segment-{name}").where("kind = 'word'")
        listed = own.select("term").distinct().select("term", F.explode(F.array_distinct(F.array(*[F.left("term", F.lit(n)) for n in PREFIXES]))).alias("prefix")).where(F.length("prefix") >= PREFIXES[0])
        dealt(listed, "prefix", "term").sortWithinPartitions("bucket", "prefix", "term").write.partitionBy("bucket").parquet(f"{self.path}/prefixes-{name}")
        own.agg(F.lit(n_docs).cast("long").alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_words")).write.parquet(f"{self.path}/sizes-{name}")
        version = self._version() + 1
        self._spark.createDataFrame([(version, [*beside, name])], "version long, segments array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/live")

    # Reading

    def _live(self) -> DataFrame:
        return self._spark.read.schema("version long, segments array<string>").parquet(f"{self.path}/live")

    def _known(self) -> bool:
        root = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/live")
        return root.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(root)

    def _version(self) -> int:
        return (self._live().agg(F.max("version").alias("v")).first().v or 0) if self._known() else 0

    def segments(self) -> list[str]:
        """The names of the live segments, ``fan_in`` and one at most."""
        last = self._live().orderBy(F.desc("version")).first() if self._known() else None
        return list(last.segments) if last else []

    def _postings(self, kind: str) -> DataFrame:
        each = [self._spark.read.schema(POSTINGS).parquet(f"{self.path}/segment-{s}") for s in self.segments()]
        return reduce(DataFrame.unionByName, each).where(F.col("kind") == kind).select("term", "doc", "tf", "len", "bucket")

    def _sizes(self) -> DataFrame:
        each = [self._spark.read.schema("n_docs long, n_words long").parquet(f"{self.path}/sizes-{s}") for s in self.segments()]
        return reduce(DataFrame.unionByName, each).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))

    def postings(self, terms: list[str], *, kind: str = "word") -> DataFrame:
        """``term, doc, tf, len`` of the terms: the buckets and terms are constants, so only their folders are read."""
        asked = sorted({t.lower() for t in terms})
        where = reduce(lambda a, b: a | b, [(F.col("bucket") == _bucket(F.lit(t))) & (F.col("term") == t) for t in asked])
        return self._postings(kind).where(where).drop("bucket")

    def words_with(self, prefix: str) -> DataFrame:
        """``term``: the indexed words that begin with ``prefix``, of two letters or more."""
        prefix = prefix.lower()
        if len(prefix) < PREFIXES[0]:
            raise ValueError(f"a prefix has {PREFIXES[0]} letters at least")
        head = prefix[: PREFIXES[-1]]
        each = [self._spark.read.schema("term string, prefix string, bucket int").parquet(f"{self.path}/prefixes-{s}") for s in self.segments()]
        return reduce(DataFrame.unionByName, each).where((F.col("bucket") == _bucket(F.lit(head))) & (F.col("prefix") == head) & F.col("term").startswith(prefix)).select("term").distinct()

    def search(self, terms: list[str], *, stemmed: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``doc, score`` by BM25 of the documents with a term. A term that ends in ``*`` is a prefix: its words count as one term."""
        exact, heads = [t for t in terms if not t.endswith("*")], [t[:-1] for t in terms if t.endswith("*")]
        found = []
        if exact and stemmed:
            asked = self._spark.createDataFrame([(t.lower(),) for t in exact], "t string").select(stem(F.col("t")).alias("t")).distinct().collect()
            found.append(self.postings([r.t for r in asked], kind="stem"))
        elif exact:
            found.append(self.postings(exact))
        for head in heads:
            own = self.words_with(head).withColumn("bucket", _bucket(F.col("term")))
            found.append(self._postings("word").join(own, ["bucket", "term"]).groupBy("doc", "len").agg(F.sum("tf").alias("tf")).withColumn("term", F.lit(f"{head.lower()}*")))
        hits = reduce(DataFrame.unionByName, [f.select("term", "doc", "tf", "len") for f in found])
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        j = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(self._sizes()))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (F.col("n_words") / F.col("n_docs"))))
        return j.groupBy("doc").agg(F.round(F.sum(part), 5).alias("score"))

    def search_or_contains(self, docs: DataFrame, ident: str, text: str, query: str, **options) -> DataFrame:
        """As ``search`` for the words of ``query``; where no document has one, those that contain the query in any case, at score 0.5."""
        found = cut(self.search(query.split(), **options))
        if not found.isEmpty():
            return found
        return docs.where(F.lower(F.col(text)).contains(query.lower())).select(F.col(ident).alias("doc"), F.lit(0.5).alias("score"))

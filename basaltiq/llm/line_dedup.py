"""Line dedup over levelled sorted runs of line hashes.

A run holds ``(h1, h2, n_docs, keeper, fresh)``, one row a key, dealt by the 128-bit hash of the line key into buckets of
equal shares and sorted in each: every run is cut at the same places, so a batch meets a run bucket by bucket, as a merge
that shuffles no run. Each batch of documents is merge-anti-joined with all runs. Keys that none has are fresh: they enter
the new run as keys, with this batch's count and largest id. Keys that a run has already are not added again; they stand
in the new run as updates to it. When ``fan_in`` runs stand on a level they are compacted into one run of the next level,
as in an LSM tree: updates are settled into the keys that the level holds, and the others stay updates. At the end every
key, which stands fresh in exactly one run, takes the updates to it. Any split into batches gives the same table; their
number follows the input, ``batch_rows`` hashes to a batch, up to ``SLICES``.

Defined results: a null or empty text is one empty line; a row with a null ``doc_id`` holds no identity, so its lines
count for nothing and none is dropped; rows that repeat a ``doc_id`` are one document for counting and each lose the
same lines; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basaltiq.llm.common import fresh_path, written

KEY = ("h1", "h2")
#: Parts in which the hashes are written, each a batch at most or together with others.
SLICES = 16


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends, A-Z lower-cased (``bytes.lower`` changes only those)."""
    return line.strip(" \t\n\r\x0b\x0c").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _halves(key: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _long_keys(text: str | None, least: int) -> set[tuple[int, int]]:
    return {_halves(k) for line in (text or "").split("\n") if len(line) >= least and len(k := line_key(line)) >= least}


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, h1, h2)``: each document's distinct keys of at least ``min_chars`` code points."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h1, h2 = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for x, y in _long_keys(t, min_chars):
                    ids.append(i)
                    h1.append(x)
                    h2.append(y)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, h1, h2)], names=["doc_id", "h1", "h2"])

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(rows, "doc_id long, h1 long, h2 long")


@dataclass
class LineRuns:
    """The levelled store. ``levels[i]`` lists the runs on level i, tables that are dealt and sorted by the key."""

    spark: SparkSession
    fan_in: int = 4
    levels: list[list[str]] = field(default_factory=list)

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(*KEY, "n_docs", "keeper", "fresh").repartition(n, *KEY)
        dealt.write.option("path", fresh_path(self.spark, name)).option("compression", "zstd").bucketBy(n, *KEY).sortBy(*KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, hashes: DataFrame) -> None:
        """Add a batch of distinct ``(doc_id, h1, h2)``, whose documents are in no earlier batch."""
        own = hashes.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            keys = self.spark.table(run).where("fresh").select(*KEY, F.lit(True).alias(f"in_{i}"))
            own = own.join(keys.hint("merge"), list(KEY), "left")
            known = known | F.coalesce(f"in_{i}", F.lit(False))
        self._write(own.withColumn("fresh", ~known), 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            rows = reduce(DataFrame.unionByName, [self.spark.table(run) for run in self.levels[level]])
            merged = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh"))
            old, self.levels[level] = self.levels[level], []
            self._write(merged, level + 1)
            self._drop(old)
            level += 1

    def _drop(self, runs: list[str]) -> None:
        for run in runs:  # the catalog's entry
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def table(self) -> DataFrame:
        """``h1, h2, n_docs, keeper``: every key with the updates to it, as a written table; the store is empty then."""
        runs = [self.spark.table(run) for run in self.runs()]
        keys = reduce(DataFrame.unionByName, [r.where("fresh") for r in runs]).drop("fresh")
        late = reduce(DataFrame.unionByName, [r.where("not fresh") for r in runs])
        late = late.groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("keeper").alias("later"))
        done = keys.join(late, list(KEY), "left").select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("keeper", "later").alias("keeper"))
        out = written(done, "line-keys")
        self._drop(self.runs())
        self.levels = []
        return out


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batch_rows: int = 1_000_000, fan_in: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, kept, n_lines, n_dropped, kept_sha256`` and the columns named in ``keep``, one row a document.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines but those of the
    largest ``doc_id``. Shuffled: 24 bytes for each distinct line of a document, and each text once, by its id.
    """
    spark = docs.sparkSession
    hashes = line_hashes(docs, min_chars).dropDuplicates([*KEY, "doc_id"])
    hashes = written(hashes.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int")), "line-hashes", partition_by="batch")
    n_batches = max(1, min(SLICES, -(-hashes.count() // batch_rows)))
    runs = LineRuns(spark, fan_in)
    for k in range(n_batches):
        runs.add(hashes.where(F.floor(F.col("batch") * n_batches / SLICES) == k))
    common = runs.table().where(F.col("n_docs") >= min_docs).select(*KEY, "keeper")
    drop = hashes.join(common, list(KEY)).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("drop"))

    extra = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "text")]
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType()), *[T.StructField(f"x_{c}", docs.schema[c].dataType) for c in extra]])

    def keep_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, drops in zip(b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True):
                kept = lines = (text or "").split("\n")
                if drops:
                    gone = {(d["h1"], d["h2"]) for d in drops}
                    kept = [x for x in lines if not (len(x) >= min_chars and len(k := line_key(x)) >= min_chars and _halves(k) in gone)]
                joined = "\n".join(kept)
                rows.append((joined, len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest()))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            passed = [b.column(f"x_{c}") for c in extra]
            yield pa.record_batch([b.column("doc_id"), *made, *passed], names=out.names)

    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"x_{c}") for c in extra])
    # Rows without an id lose nothing; in the join they would all meet in one task.
    nameless = left.where("doc_id is null").withColumn("drop", F.lit(None).cast(drop.schema["drop"].dataType))
    both = left.where("doc_id is not null").join(drop, "doc_id", "left").unionByName(nameless)
    return both.select("doc_id", "text", "drop", *[f"x_{c}" for c in extra]).mapInArrow(keep_lines, out)


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, line,
         translate(trim(line, E' \t\n\r\x0b\x0c'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.k IS NOT NULL AND l.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.k IS NULL OR l.doc_id = c.keeper THEN l.line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.k = c.k
GROUP BY l.doc_id
"""

"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

A window (13 consecutive words of an item, or all words of a shorter item) counts as the sequence of its shingles, four
words each. A document contains a window only if it holds all its shingles, so for exact containment the necessary
prefix is one shingle: the one that is rarest over all documents.

1. One pass splits every text, walks its positions and keeps those whose shingle is one of the benchmark's, and a row
   for the document itself. That table, a few rows a document, gives the counts and everything that follows.
2. Each window's rarest shingle is joined with the kept positions; its offset fixes where the window would start
   (positional bound), and the window must end within the document (length bound).
3. Texts of documents with a candidate are read again and the window's words are compared one by one.

The benchmark's shingles are dealt in blocks of at most ``block_rows`` longs and each block is broadcast, so documents are
never shuffled before they are candidates, and a larger benchmark costs more passes, not more memory.

Defined results: null or empty texts have no words and no hits; an item without words has no window; a repeated item id
counts once; rows that repeat a ``doc_id`` share the hits of all of them only if their texts do, since hits are kept
by (doc_id, text hash); a null ``doc_id`` is matched like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import BROADCAST_ROWS, ascii_lower, written

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 4


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def windows_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``win, words, k``: distinct windows and their shingle length; and ``win, item_id``: the items that hold them."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("words")).withColumn("win", F.xxhash64("words"))
    windows = each.select("win", "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct()
    return written(windows, "windows"), written(each.select("win", "item_id").distinct(), "window-items")


def _walked(rows: DataFrame, lengths: list[int], *cols: str) -> DataFrame:
    """``cols, pos, h``: a row for the hash of each shingle in ``words``, and one with ``pos`` -1 and ``h`` 0 for the row itself.

    Positions are generated and words taken by index, so that no step leaves generated code.
    """
    at = rows.select(*cols, "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - min(lengths), F.lit(-1)))).alias("pos"))
    pos, self_ = F.col("pos"), F.col("pos") < 0
    hash_ = lambda k: F.xxhash64(F.lit(k), *[F.get("words", pos + i) for i in range(k)])
    if len(lengths) == 1:
        return at.select(*cols, "words", "pos", F.when(self_, F.lit(0)).otherwise(hash_(lengths[0])).alias("h"))
    each = [F.when(self_, F.lit(0) if i == 0 else F.lit(None)).when(pos + k <= F.size("words"), hash_(k)).cast("long") for i, k in enumerate(lengths)]
    return at.select(*cols, "words", "pos", F.explode(F.array(*each)).alias("h")).where("h is not null")


def _blocks(rows: DataFrame, size: int, key: str) -> list[DataFrame]:
    n = max(1, -(-rows.count() // size))
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def _side(rows: DataFrame) -> DataFrame:
    """Broadcast if it is known to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on equal ``did``, also with a null id."""
    keyed = right.select(F.col("did.id").alias("r_id"), F.col("did.t").alias("r_t"), *[c for c in right.columns if c != "did"])
    return left.join(keyed, F.col("did.id").eqNullSafe(F.col("r_id")) & (F.col("did.t") == F.col("r_t")), how).drop("r_id", "r_t")


def _same_text(docs: DataFrame, did: DataFrame) -> DataFrame:
    """The documents whose text hash is in ``did``, where that is a small table; else all, for the join that follows."""
    texts = did.select(F.col("did.t").alias("r_t")).distinct()
    return docs.join(F.broadcast(texts), F.col("did.t") == F.col("r_t"), "left_semi") if texts.count() <= BROADCAST_ROWS else docs


def hits(docs: DataFrame, benchmark: DataFrame, *, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``did, n`` with the words of each row of ``docs (did, text)``; ``did, start, len, win``, every occurrence of a window in a
    document; and ``win, item_id``."""
    windows, items = windows_of(benchmark)
    lengths = [r["k"] for r in windows.select("k").distinct().orderBy("k").collect()] or [SHINGLE]  # at most SHINGLE rows
    # The benchmark's shingles, with their offsets in each window.
    inside = reduce(DataFrame.unionByName, [_walked(windows.where(F.col("k") == k), [k], "win").where("pos >= 0").select("win", F.col("pos").alias("off"), "h") for k in lengths])
    inside = written(inside, "window-shingles")
    split = docs.select("did", words_of(F.col("text")).alias("words"))
    seen = []
    for k, block in enumerate(_blocks(inside.select("h").distinct(), block_rows, "h")):
        known = block.unionByName(docs.sparkSession.range(1).select(F.col("id").alias("h"))) if k == 0 else block
        seen.append(_walked(split, lengths, "did").join(F.broadcast(known), "h").select("did", "pos", "h", F.size("words").alias("n")))
    held = written(reduce(DataFrame.unionByName, seen), "shingle-hits")
    kept = held.where("pos >= 0")
    # Prefix of each window: its rarest shingle. One that no document holds has no count, and drops the window.
    rarity = kept.groupBy("h").agg(F.count("*").alias("df"))
    ranked = inside.join(rarity, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("p")).where("p.df > 0")
    prefix = ranked.select("win", F.col("p.h").alias("h"), F.col("p.off").alias("off")).join(windows.select("win", F.size("words").alias("len")), "win")
    prefix = written(prefix, "window-prefixes")
    start = F.col("pos") - F.col("off")
    near = kept.join(_side(prefix), "h").where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("did", start.alias("start"), "len", "win")
    # A list for each document, so that equal rows do not meet each other's candidates.
    asked = written(near.groupBy("did").agg(F.collect_set(F.struct("start", "len", "win")).alias("asked")), "window-candidates")
    again = _same_text(docs, asked).select("did", words_of(F.col("text")).alias("words"))
    again = _with(again, asked).select("did", "words", F.explode("asked").alias("c"))
    piece = F.slice("words", F.col("c.start") + 1, F.col("c.len")).alias("piece")
    compared = again.select("did", "c.start", "c.len", "c.win", piece).join(_side(windows.select("win", "words")), "win").where("piece = words")
    return held.where("pos < 0").select("did", "n"), compared.select("did", "start", "len", "win").distinct(), items


def covered_words(spans: Column) -> Column:
    """Positions inside any of the spans ``(start, len)``."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"))

    return F.aggregate(F.sort_array(spans), first, step, lambda acc: acc["n"])


def judged(docs: DataFrame, benchmark: DataFrame, block_rows: int) -> DataFrame:
    """``doc_id, t, n_words, n_hit, n_items, items_sha256, contaminated`` for every document; ``t``: hash of the text."""
    doc_id = F.col("doc_id").cast("long")
    words, found, items = hits(docs.select("text", F.struct(doc_id.alias("id"), F.xxhash64("text").alias("t")).alias("did")), benchmark, block_rows=block_rows)
    found = written(found, "window-hits")
    spans = found.groupBy("did").agg(covered_words(F.collect_set(F.struct("start", "len"))).cast("long").alias("n_hit"))
    held = found.select("did", "win").distinct().join(_side(items), "win").groupBy("did").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    by_doc = _with(spans, held).select("did", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    joined = _with(words, by_doc, "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n").cast("long")
    return joined.select(
        F.col("did.id").alias("doc_id"), F.col("did.t").alias("t"), n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    return judged(docs, benchmark, block_rows).drop("t")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = judged(docs, benchmark, block_rows).where("contaminated").select(F.col("doc_id").alias("k_id"), F.col("t").alias("k_t")).distinct()
    bad = written(bad, "contaminated")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["k_id"]) & (F.xxhash64(docs["text"]) == side["k_t"]), "left_anti")

"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

Documents are encoded once and dealt into groups of about ``group_tokens`` tokens. In a group each source has a queue
and a deficit, in tokens times 2**30, exact integers. Every window of ``window`` tokens credits each source with its
target share and is filled from the sources that are owed most, in turns of at least ``quantum`` tokens where the
queue has them; what a window could not pay is carried to the next one. A group starts with what all groups before it
left owing, which follows from token counts alone, so groups run in parallel.

Each id lies in exactly one piece, a group leaves at most one window unfilled, and a document may span windows.

Defined results: a null or empty text is its end id alone; a null source is a source of its own; repeated rows and
null ``doc_id`` are documents like any other; no documents give no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltiq.llm.common import sources_of, written
from basaltiq.llm.tokens import encoder, parts

UNIT = 1 << 30
CHAIN = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, source, n, ids``: ids as little-endian unsigned 16-bit integers (32-bit where one is larger), end id last."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            at = 0
            for texts in parts(b.column("text")):
                ids, ends = encode(texts, end_id)
                width = "<u2" if ids.max() < 65536 else "<u4"
                packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends * int(width[-1])), pa.py_buffer(ids.astype(width))])
                own = b.slice(at, len(texts))
                yield pa.record_batch([own.column("doc_id"), own.column("source"), pa.array(np.diff(ends)), packed.cast(pa.binary())], names=["doc_id", "source", "n", "ids"])
                at += len(texts)

    own = sources_of(docs, "doc_id", "source", "text")
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(rows, "doc_id long, source string, n long, ids binary")


def unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


class Queue:
    """The documents of one source, taken from the front in any lengths."""

    def __init__(self, weight: int, owed: int) -> None:
        self.weight, self.owed, self.left = weight, owed, 0
        self._docs: deque[tuple[int | None, np.ndarray]] = deque()
        self._at = 0

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id, ids))
        self.left += len(ids)

    def take(self, n: int) -> Iterator[tuple[int | None, int, np.ndarray, int]]:
        """``(doc_id, start, ids, length of the document)`` until ``n`` tokens are taken."""
        self.owed -= n * UNIT
        self.left -= n
        while n:
            doc_id, ids = self._docs[0]
            piece = ids[self._at : self._at + n]
            yield doc_id, self._at, piece, len(ids)
            n -= len(piece)
            self._at += len(piece)
            if self._at == len(ids):
                self._docs.popleft()
                self._at = 0


def fill(queues: dict[str, Queue], window: int, quantum: int) -> Iterator[list[tuple]]:
    """Windows, each a list of pieces that together have ``window`` tokens; the last may have fewer.

    First pay those that are owed a quantum or more, the most owed first; then, if room is left, the most owed ones get
    a turn in advance. Sources whose queue has run dry lose no claim but cannot use it.
    """
    while any(q.left for q in queues.values()):
        for q in queues.values():
            q.owed += q.weight * window
        room, pieces = window, []
        while room and (open_ := sorted((-q.owed, name) for name, q in queues.items() if q.left)):
            due = [(minus, name) for minus, name in open_ if -minus >= quantum * UNIT]
            for minus, name in due or open_[:1]:
                q = queues[name]
                n = min(max(quantum, -minus // UNIT), q.left, room)
                pieces += q.take(n)
                room -= n
                if not room:
                    break
        yield pieces


def claims(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """``gid, source, weight, owed``: what each source of a group is owed when the group begins, by all groups before it.

    Running sums go over the groups of a chain, and over the chains' totals, so that no window holds more than ``CHAIN``
    groups or a row for each chain.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: F.coalesce(F.sum("n").over(earlier(w)), F.lit(0))
    own = counts.withColumn("chain", F.floor(F.col("gid") / CHAIN))
    groups = own.groupBy("chain", "gid").agg(F.sum("n").alias("n")).withColumn("all_in", so_far(Window.partitionBy("chain").orderBy("gid")))
    chains = own.groupBy("chain").agg(F.sum("n").alias("n")).withColumn("all_before", so_far(Window.orderBy("chain")))
    had_in = own.withColumn("had_in", so_far(Window.partitionBy("chain", "source").orderBy("gid")))
    had = own.groupBy("chain", "source").agg(F.sum("n").alias("n")).withColumn("had_before", so_far(Window.partitionBy("source").orderBy("chain")))
    found = had_in.drop("n").join(groups.drop("n"), ["chain", "gid"]).join(chains.drop("n"), "chain").join(had.drop("n"), ["chain", "source"]).join(shares, "source", "left")
    weight = F.coalesce("weight", F.lit(0))
    return found.select("gid", "source", weight.alias("weight"), (weight * (F.col("all_in") + F.col("all_before")) - (F.col("had_in") + F.col("had_before")) * F.lit(UNIT)).alias("owed"))


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, window: int = 2048, quantum: int = 256, group_tokens: int = 4_000_000, mixture: dict[str, float] | None = None) -> DataFrame:
    """A row for each piece (columns PIECES). ``mixture``: target shares by source; by default those of the corpus."""
    tokens = written(encoded(docs, tokenizer, end_id).withColumn("rid", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    n_groups = max(1, -(-total // group_tokens))
    name = F.coalesce("source", F.lit("\0null"))
    dealt = tokens.select("doc_id", "n", "ids", "rid", name.alias("source"), F.pmod(F.xxhash64("rid"), F.lit(n_groups)).alias("gid"))

    counts = written(dealt.groupBy("gid", "source").agg(F.sum("n").alias("n")), "group-counts")
    if mixture is None:
        shares = counts.groupBy("source").agg(F.sum("n").alias("n")).select("source", F.floor(F.col("n") * F.lit(float(UNIT)) / F.lit(max(total, 1))).cast("long").alias("weight"))
    else:
        whole = sum(mixture.values())
        shares = docs.sparkSession.createDataFrame([(s, int(UNIT * v / whole)) for s, v in mixture.items()], "source string, weight long")
    owed = claims(counts, shares)

    def packed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queues = {s: Queue(int(w), int(o)) for s, w, o in zip(right["source"], right["weight"], right["owed"], strict=True)}
        order = np.argsort(left["rid"].to_numpy(), kind="stable")
        ids_of, n_of, source_of, doc_of = (left[c].to_numpy() for c in ("ids", "n", "source", "doc"))
        for k in order:
            queues[source_of[k]].put(doc_of[k], unpacked(ids_of[k], int(n_of[k])))
        cols: list[list] = [[] for _ in range(7)]
        first = int(left["gid"].iloc[0]) << 32 if len(left) else 0
        for w, pieces in enumerate(fill(queues, window, quantum)):
            at = 0
            for doc_id, start, ids, whole in pieces:
                for col, value in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, first + w, at), strict=True):
                    col.append(value)
                at += len(ids)
        return pd.DataFrame(dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), cols, strict=True))).astype({"doc_id": object})

    # As text, ids stay exact where some are null.
    by_group = dealt.select("gid", "rid", "n", "ids", "source", F.col("doc_id").cast("string").alias("doc")).groupBy("gid")
    rows = by_group.cogroup(owed.groupBy("gid")).applyInPandas(packed, PIECES.replace("doc_id long", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))

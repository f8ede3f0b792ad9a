"""Exact n-gram Jaccard join with signature trees.

1. Texts become sets of hashed shingles; texts with equal sets are one class, named by a hash of the set.
2. Sets that reach the threshold share a token among the ``n - ceil(t n) + 1`` first ones of each in any common order.
   Counts of all shingles in a sketch, whose size follows the corpus up to ``2**MOST_BITS`` buckets, put frequent ones
   last. Tokens of this prefix deal the classes into blocks; tokens of frequent buckets are salted, and blocks of one
   class fall away as their rows stream by.
3. In each block every class is compared with the most central one, whose prefix tokens are the most common to others,
   and the links found are contracted. A group of copies has its original there, which settles most of it.
4. Of two sets, the one whose prefix ends first has all its common prefix tokens in the other's prefix. So a link shares
   at least the needed overlap less the longer rest of the two (``shared_least``). A class that stands in fewer open
   blocks (those of several components) than any size in a block asks for leaves that block.
5. The open blocks are joined by signature trees: leaves are classes, nodes hold OR-combined bitmaps of their tokens in
   open blocks, size ranges and, if it is only one, the component. Both sides are traversed together; a pair of nodes is
   left when it is of one component, when sizes exclude the threshold, or when even all common bits and all tokens that
   share a bit are too few. Large blocks are cut into chunks, and each pair of chunks is a unit of work. Every class bears
   the ``LOW`` least of its open tokens; a pair is reported by the block of the least token common to these, so once.
   Where they have none in common, each common block reports it, and the reports must reach the bound.
6. The pairs that remain are verified on whole sets in one stream: a set is sent once to each part of a partner's list.

No pair that reaches the threshold is lost but such as are connected otherwise; nothing is capped. Defined results: a
null or empty text, or one without words, has no set and is its own component; fewer words than a shingle are one
shingle; repeated rows are one class; rows with null ``doc_id`` join their class but do not name it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import BROADCAST_ROWS, sources_of, written
from basaltiq.llm.components import components

#: The sketch has a bucket for about ``LOAD`` shingles, and between these powers of two.
LEAST_BITS, MOST_BITS, LOAD = 16, 22, 16
#: Buckets whose counts go together through a shuffle.
PART = 8192
MOST = np.uint64(2**32 - 1)
BITS = 512
CHUNK = 1024
FANOUT = 8
LOW = 8


# Bytes hash by a table in which A-Z are a-z, words by a polynomial of their bytes, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
_TABLE = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([k + 32 if 65 <= k <= 90 else k])) for k in range(256)), "<u8").astype(np.uint64)
SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of ``data``."""
    arr = np.frombuffer(data, np.uint8)
    gap = _GAP[arr]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first
    up, down = _power(len(arr))
    sums = np.zeros(len(arr) + 1, np.uint64)
    np.cumsum(_TABLE[arr] * up[: len(arr)], out=sums[1:])
    return _mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)), first


def _sets_of_group(texts: list[bytes], size: int) -> list[np.ndarray]:
    joined = b"\n".join(texts)
    hashes, first = _word_hashes(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.concatenate([[0], np.searchsorted(first, ends)])
    return _sets_of_words(hashes, cuts, size)


def _sets_of_words(hashes: np.ndarray, cuts: np.ndarray, size: int) -> list[np.ndarray]:
    """The set of each document, whose words are ``hashes[cuts[k]:cuts[k + 1]]``."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    total = _mixed(total)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(total[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:  # the whole sequence; the seed keeps other lengths apart
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _long_set(data: bytes, size: int) -> np.ndarray:
    """A text longer than a segment: its words by segments that end at a gap."""
    parts, at = [], 0
    while at < len(data):
        end = at + SEGMENT
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        parts.append(_word_hashes(data[at:end])[0])
        at = end
    hashes = np.concatenate(parts)
    return _sets_of_words(hashes, np.array([0, len(hashes)]), size)[0]


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of ``size`` consecutive words, ascending; many texts at once."""
    out: list[np.ndarray] = []
    group, held = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if held + len(data) > SEGMENT and group:
            out += _sets_of_group(group, size)
            group, held = [], 0
        if len(data) > SEGMENT:
            out.append(_long_set(data, size))
        else:
            group.append(data)
            held += len(data) + 1
    return out + (_sets_of_group(group, size) if group else [])


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def needed(total: int, percent: int) -> int:
    """Least overlap of two sets with ``total`` tokens together whose Jaccard similarity reaches ``percent``."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n + (percent * n // -100) + 1


def bucket(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places in the sketch, whose size is a power of two."""
    return (tokens & np.uint64(len(counts) - 1)).astype(np.int64)


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    order = np.lexsort((s, counts[bucket(s, counts)]))
    return s[order[: prefix_length(len(s), percent)]]


def bitmap(tokens: np.ndarray) -> bytes:
    """Bits from the upper part of the hash, which the sketch does not use."""
    return np.packbits(np.bincount((tokens >> np.uint64(40) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) > 0).tobytes()


def shared_least(low: int, other_low: int, high: int, percent: int) -> int:
    """Prefix tokens that a link shares at least: sets of at least ``low`` and ``other_low`` tokens, none over ``high``."""
    return needed(low + other_low, percent) - (high + 1 - prefix_length(high, percent)) + 1


def _side(rows: DataFrame) -> DataFrame:
    """A written table of short rows, broadcast if its number of rows allows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


# ------------------------------------------------------------------ passes over texts


def classes(docs: DataFrame, counts: Broadcast, size: int, percent: int) -> DataFrame:
    """``doc_id, t, n, sid, bits`` of every document; no ``sid`` and ``bits`` where there is no set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                sets = shingle_sets(part.column("text").to_pylist(), size)
                made = [(len(s), set_id(s), bitmap(prefix(s, counts.value, percent))) if len(s) else (0, None, None) for s in sets]
                yield pa.record_batch([part.column("doc_id"), part.column("t"), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "t", "n", "sid", "bits"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(rows, "doc_id long, t long, n long, sid long, bits binary")


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Documents by shingle bucket, in 32 bits, so that counts still tell frequent tokens apart at ``2**MOST_BITS`` buckets of a
    hundred thousand shingles each: every task counts all buckets, and parts of them are added up as they stream by. The driver
    gets four bytes a bucket, 16 MB at most."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 << min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(1, chars / 6 / LOAD)))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.uint32)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for s in shingle_sets(b.column("text").slice(k, 256).to_pylist(), size):
                    np.add.at(total, bucket(s, total), np.uint32(1))
        part = total.reshape(-1, PART)
        used = np.flatnonzero(part.any(axis=1))
        for k in range(0, len(used), 256):
            own = [part[i].astype(np.min_scalar_type(part[i].max())).tobytes() for i in used[k : k + 256]]
            yield pa.record_batch([pa.array(used[k : k + 256], pa.int32()), pa.array(own, pa.binary())], names=["part", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                data = counts.as_buffer()
                own = total.setdefault(k, np.zeros(PART, np.uint64))
                own += np.frombuffer(data, f"u{len(data) // PART}")
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, MOST).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((n // PART, PART), np.uint32)
    for r in docs.select("text").mapInArrow(rows, "part int, counts binary").repartition("part").mapInArrow(added, "part int, counts binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def blocks(docs: DataFrame, sent: Broadcast, size: int, percent: int) -> DataFrame:
    """``token, sid, n``: classes by prefix token, for tokens of two or more classes."""
    # A bucket whose count stands far out holds a frequent token; its rows are salted and kept.
    mean = sent.value.mean()
    hot = int(mean + 8 * np.sqrt(mean) + 1000)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                tokens, salts, sids, ns = [], [], [], []
                for s in shingle_sets(b.column("text").slice(k, 1024).to_pylist(), size):
                    if not len(s):
                        continue
                    p, sid = prefix(s, sent.value, percent), set_id(s)
                    tokens.append(p)
                    salts.append(np.where(sent.value[bucket(p, sent.value)] > hot, 1 + sid % 64, 0).astype(np.int32))
                    sids.append(np.full(len(p), sid, np.int64))
                    ns.append(np.full(len(p), len(s), np.int64))
                if tokens:
                    yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(ns))], names=["token", "salt", "sid", "n"])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (token, salt, sid): distinct ones, without tokens that stand alone."""
        held = None  # the last row, whose successor is not known yet, and whether its token came before
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "sid", "n")]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)]
            token, salt, sid, _ = cols
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (sid[1:] != sid[:-1])
            cols = [c[new] for c in cols]
            token, salt = cols[0], cols[1]
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            keep = salt > 0
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None and held[1]:
                keep[0] = True
            last = bool(len(token) > 1 and same[-1]) or bool(len(token) == 1 and held is not None and held[1])
            held = ([c[-1:] for c in cols], last)
            yield pa.record_batch([pa.array(cols[k][:-1][keep[:-1]]) for k in (0, 2, 3)], names=["token", "sid", "n"])
        if held is not None and (held[1] or held[0][1][0] > 0):
            yield pa.record_batch([pa.array(held[0][k]) for k in (0, 2, 3)], names=["token", "sid", "n"])

    dealt = docs.select("text").mapInArrow(deal, "token long, salt int, sid long, n long")
    return dealt.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid").mapInArrow(crowded, "token long, sid long, n long")


def sets_of(docs: DataFrame, meta: DataFrame, wanted: DataFrame, size: int, *, repeats: bool) -> DataFrame:
    """``sid, tokens`` of the classes in ``wanted (sid)``: their sets again, from one document of each, known by its id and
    the hash of its text. ``repeats``: whether several rows may bear both."""
    side = _side(written(meta.join(wanted.distinct(), "sid").select("sid", "who"), "wanted"))
    found = docs.join(side, docs["doc_id"].eqNullSafe(side["who.doc_id"]) & (F.xxhash64(docs["text"]) == side["who.t"])).select("sid", "text")
    if repeats:
        found = found.dropDuplicates(["sid"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                sets = shingle_sets(part.column("text").to_pylist(), size)
                made = [(i, s.tobytes()) for i, s in zip(part.column("sid").to_pylist(), sets, strict=True) if len(s) and set_id(s) == i]
                yield pa.record_batch([pa.array([i for i, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())], names=["sid", "tokens"])

    return found.mapInArrow(rows, "sid long, tokens binary")


# ------------------------------------------------------------------ verification


def verify(pairs: DataFrame, sets: DataFrame, percent: int, *, part: int = 512) -> DataFrame:
    """The pairs ``(a, b)`` that reach the threshold. ``b``'s list is cut into parts of about ``part`` partners; each
    part gets b's set first and then streams its partners' sets past it."""
    pairs = written(pairs.distinct(), "pairs")
    lists = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "pair-lists")
    long = lists.where("parts > 1")  # a row for more than ``part`` pairs
    split = pairs.join(_side(long), "b", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = split.select(F.col("a").alias("sid"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    heads = lists.select(F.col("b").alias("sid"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    asked = sets.select("sid", "tokens").join(_side(written(members.unionByName(heads), "asked")), "sid").select("sid", "b", "part", "role", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, None
        for b in batches:
            found = []
            for sid, key, k, role, tokens in zip(*(b.column(c).to_pylist() for c in ("sid", "b", "part", "role", "tokens")), strict=True):
                s = np.frombuffer(tokens, np.uint64)
                if role == 0:
                    place, own = (key, k), s
                elif place == (key, k):
                    total = len(s) + len(own)
                    if 100 * min(len(s), len(own)) >= percent * max(len(s), len(own)):
                        both = np.concatenate([s, own])
                        both.sort()
                        if int((both[1:] == both[:-1]).sum()) >= needed(total, percent):
                            found.append((sid, key))
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

    return asked.repartition("b", "part").sortWithinPartitions("b", "part", "role").mapInArrow(compare, "a long, b long")


# ------------------------------------------------------------------ signature trees


@dataclass
class Node:
    """``slack``: tokens beyond the set bits, at most, of a member; ``component``: None if there are several; ``low``, ``high``: sizes;
    ``first``: a class's least open tokens."""

    bits: int
    low: int
    high: int
    slack: int
    component: int | None
    sid: int | None = None
    first: frozenset[int] = frozenset()
    children: tuple[Node, ...] = ()


def leaf(sid: int, n: int, component: int | None, bits: bytes, tokens: int, first: bytes = b"") -> Node:
    """``tokens``: the number of tokens that ``bits`` stands for."""
    signature = int.from_bytes(bits, "big")
    return Node(signature, n, n, tokens - signature.bit_count(), component, sid, frozenset(np.frombuffer(first, np.int64).tolist()))


def build(leaves: list[Node]) -> Node:
    """A tree over leaves, ordered by size, component and bits so that like ones are neighbours."""
    level = sorted(leaves, key=lambda x: (x.low.bit_length(), x.component, x.bits, x.sid))
    while len(level) > 1:
        level = [_join(tuple(level[k : k + FANOUT])) for k in range(0, len(level), FANOUT)]
    return level[0]


def _join(nodes: tuple[Node, ...]) -> Node:
    bits = 0
    for x in nodes:
        bits |= x.bits
    own = {x.component for x in nodes}
    return Node(bits, min(x.low for x in nodes), max(x.high for x in nodes), max(x.slack for x in nodes), own.pop() if len(own) == 1 else None, children=nodes)


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether some pair of their members can be a link that joins two components."""
    if x.component is not None and x.component == y.component:
        return False
    if 100 * min(x.high, y.high) < percent * max(x.low, y.low):
        return False
    return (x.bits & y.bits).bit_count() + min(x.slack, y.slack) >= shared_least(x.low, y.low, max(x.high, y.high), percent)


def traverse(left: Node, right: Node, percent: int) -> Iterator[tuple[Node, Node]]:
    """Candidate pairs of members; with ``left is right`` each pair once."""
    todo = [(left, right)]
    while todo:
        x, y = todo.pop()
        if x is y:
            if x.component is None:
                todo += [(a, b) for i, a in enumerate(x.children) for b in x.children[i:]]
        elif may_link(x, y, percent):
            if x.children and (not y.children or x.high - x.low >= y.high - y.low):
                todo += [(c, y) for c in x.children]
            elif y.children:
                todo += [(x, c) for c in y.children]
            elif x.sid != y.sid:
                yield (x, y) if x.sid > y.sid else (y, x)


def open_rows(held: DataFrame, percent: int) -> DataFrame:
    """Of ``token, sid, n, component``: the rows of blocks that hold several components and may still link them."""
    ends = held.groupBy("token").agg(*(f(c).alias(f"{name}_{c}") for c in ("component", "n") for name, f in (("low", F.min), ("high", F.max))))
    rows = written(held.join(ends.where("low_component <> high_component").drop("low_component", "high_component"), "token"), "open-rows")
    blocks_of = written(rows.groupBy("sid").agg(F.count("*").alias("m")), "open-blocks")
    # What a partner of the block's sizes asks for at least; it falls towards both ends, and rounding is worth one.
    n, least_n = F.col("n"), F.greatest("low_n", F.ceil(F.lit(percent) * F.col("n") / 100))
    most_n = F.least("high_n", F.floor(F.lit(100) * F.col("n") / percent))
    asked = F.least(_shared_least(n, least_n, percent), _shared_least(n, most_n, percent)) - 1
    held = written(rows.join(_side(blocks_of), "sid").where(F.col("m") >= asked).select("token", "sid", "n", "component"), "open-rows")
    several = held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    return held.join(several, "token")


def _shared_least(n: Column, m: Column, percent: int) -> Column:
    """``shared_least`` for two sizes."""
    return F.ceil(F.lit(percent) * (n + m) / (100 + percent)) - F.ceil(F.lit(percent) * F.greatest(n, m) / 100) + 1


def signed(rows: DataFrame) -> DataFrame:
    """The rows ``token, sid, n, component``, each with its class's ``m`` tokens as bitmap ``bits`` and the least ones, ``first``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "token", "n", "component")]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if len(cols[0]):
                last = int(np.searchsorted(cols[0], cols[0][-1]))  # rows come by class, and the last one may go on
                held = [c[last:] for c in cols]
                yield of([c[:last] for c in cols])
        if held is not None:
            yield of(held)

    def of(cols: list[np.ndarray]) -> pa.RecordBatch:
        sid, token, n, component = cols
        cuts = np.append(np.flatnonzero(np.diff(sid, prepend=~sid[:1])), len(sid)) if len(sid) else np.zeros(1, int)
        m, bits, first = [], [], []
        for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m += [e - a] * (e - a)
            bits += [bitmap(token[a:e].view(np.uint64))] * (e - a)
            first += [np.sort(token[a:e])[:LOW].tobytes()] * (e - a)
        made = [pa.array(token), pa.array(sid), pa.array(n), pa.array(component), pa.array(m, pa.int64()), pa.array(bits, pa.binary()), pa.array(first, pa.binary())]
        return pa.record_batch(made, names=["token", "sid", "n", "component", "m", "bits", "first"])

    by_class = rows.select("sid", "token", "n", "component").repartition("sid").sortWithinPartitions("sid")
    return by_class.mapInArrow(sign, "token long, sid long, n long, component long, m long, bits binary, first binary")


def tree_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """``a, b``: candidate pairs in the blocks of the signed rows ``rest``."""
    chunks = rest.groupBy("token").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")  # a row for more than CHUNK
    own = rest.join(_side(chunks), "token", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = own.withColumn("k", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    # Each row goes to the pairs of chunks (k, j) and (j, k), of which the one with i <= j is the unit.
    units = own.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select(*rest.columns, "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, left, right = None, [], []

        def found() -> Iterator[tuple[int, int, int, int, int]]:
            if not left or (unit[1] == unit[2] and len(left) < 2) or (unit[1] != unit[2] and not right):
                return
            tree = build(left)
            for x, y in traverse(tree, tree if unit[1] == unit[2] else build(right), percent):
                both = x.first & y.first
                if not both or min(both) == unit[0]:
                    yield x.sid, y.sid, x.low, y.low, shared_least(x.low, y.low, max(x.low, y.low), percent) if both else 1

        def batch(pairs: list[tuple[int, ...]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[k] for x in pairs], pa.int64()) for k in range(5)], names=["a", "b", "n_a", "n_b", "shared"])

        for b in batches:
            pairs: list[tuple[int, ...]] = []
            for token, i, j, k, sid, n, c, m, bits, first in zip(*(b.column(x).to_pylist() for x in ("token", "i", "j", "k", "sid", "n", "component", "m", "bits", "first")), strict=True):
                if (token, i, j) != unit:
                    pairs += found()
                    unit, left, right = (token, i, j), [], []
                    if len(pairs) > 100_000:
                        yield batch(pairs)
                        pairs = []
                (left if k == i else right).append(leaf(sid, n, c, bits, m, first))
            yield batch(pairs)
        yield batch(list(found()))

    dealt = units.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(rows, "a long, b long, n_a long, n_b long, shared long")
    met = dealt.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return met.where(F.col("shared") >= _shared_least(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def pruned(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that the bound leaves, by bitmaps of whole prefixes."""
    side = lambda name: meta.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = lambda sid, n, bits: leaf(sid, n, None, bits, prefix_length(n, percent))
        for b in batches:
            cols = zip(*(b.column(c).to_pylist() for c in ("a", "n_a", "bits_a", "b", "n_b", "bits_b")), strict=True)
            kept = [(x.sid, y.sid) for a, n, bits, c, m, more in cols if may_link(x := node(a, n, bits), y := node(c, m, more), percent)]
            yield pa.record_batch([pa.array([k[i] for k in kept], pa.int64()) for i in range(2)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(rows, "a long, b long")


# ------------------------------------------------------------------ the join


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, t, n, sid, root`` of every document; ``t``: hash of the text, ``root``: the least class that its class reaches."""
    own = sources_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = docs.sparkSession.sparkContext.broadcast(sketch(own, size))
    named = written(classes(own, counts, size, percent), "classes")
    repeats = bool(named.where("sid is not null").groupBy("doc_id", "t").count().where("count > 1").limit(1).count())
    who = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")).alias("who")
    meta = written(named.where("sid is not null").groupBy("sid").agg(who, F.min("n").alias("n"), F.min("bits").alias("bits")), "class-bits")
    dealt = written(blocks(own, counts, size, percent), "blocks")

    # First each block's most central class against the others.
    central = dealt.join(_side(written(dealt.groupBy("sid").agg(F.count("*").alias("blocks")), "class-blocks")), "sid")
    pivots = central.groupBy("token").agg(F.max(F.struct("blocks", "sid", "n")).alias("p")).select("token", "p.sid", "p.n").toDF("token", "b", "m")
    first = dealt.join(pivots, "token").where("sid <> b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    first = written(pruned(first.select(F.col("sid").alias("a"), "b").distinct(), meta, percent), "pivot-pairs")
    sets = sets_of(own, meta, first.select(F.explode(F.array("a", "b")).alias("sid")), size, repeats=repeats)
    links = written(verify(first, sets, percent), "pivot-links")
    found = written(components(links), "pivot-components")

    # Then trees over the blocks that hold more than one component.
    held = dealt.join(_side(found).withColumnRenamed("id", "sid"), "sid", "left").select("token", "sid", "n", F.coalesce("root", "sid").alias("component"))
    rest = written(signed(open_rows(written(held, "held"), percent)), "signed-rows")
    known = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = written(tree_pairs(rest, percent).join(known, ["a", "b"], "left_anti"), "tree-pairs")
    late = verify(pairs, sets_of(own, meta, pairs.select(F.explode(F.array("a", "b")).alias("sid")), size, repeats=repeats), percent)
    found = written(components(links.unionByName(late)), "components")

    return named.join(_side(found).withColumnRenamed("id", "sid"), "sid", "left").select("doc_id", "t", "n", "sid", F.coalesce("root", "sid").alias("root"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id``; ``component_id``: smallest ``doc_id`` reachable by links."""
    all_ = written(grouped(docs, size, percent), "components")
    least = written(all_.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-names")
    out = all_.join(_side(least), "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("sid").alias("class_id"))


def deduplicate(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest ``doc_id`` stays, one of
    equal rows; documents without words all stay."""
    all_ = written(grouped(docs, size, percent), "components")
    first = all_.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("k"), F.count("*").alias("rows"))
    keys = first.select(F.col("k.doc_id").alias("k_id"), F.col("k.t").alias("k_t")).unionByName(all_.where("root is null").select(F.col("doc_id").alias("k_id"), F.col("t").alias("k_t")).distinct())
    keys = written(keys, "kept")
    side = _side(keys)
    kept = docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["k_id"]) & (F.xxhash64(docs["text"]) == side["k_t"]), "left_semi")
    repeats = all_.where("root is not null").groupBy("doc_id", "t").count().where("count > 1").limit(1).count()
    if repeats:  # ids that several equal rows bear; without words they stay
        worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(worded).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(~worded))
    return kept

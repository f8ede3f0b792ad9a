"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Every word (a run of letters, of digits or of other signs, case kept) falls into one of ``n_buckets`` buckets. A
   bucket has a sparse random index vector: ``NONZERO`` entries of +1 or -1 among ``dim``, derived from its number.
   Its context vector is the sum of the index vectors of the two words before and after each of its occurrences, over
   all documents. The sums are integers, so they do not depend on how rows are dealt, and there are
   ``n_buckets x dim`` of them whatever the size of the corpus (the one thing that reaches the driver and is sent out).
2. A document is the mean of its words' unit vectors, the mean product of neighbours' vectors, and a few lengths.
3. A network with one hidden layer learns labels of at most ``max_train`` documents, a documented bound; those with the
   smallest hashes are taken. A fifth of them only sets the temperature that divides the logits.

Defined results: null and empty texts pool to zeros and are scored; conflicting labels of one document are dropped;
without two classes to learn from every score is 0.5; repeated rows are scored each alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.llm.common import sources_of, written

WORDS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
NONZERO = 2
_known: dict[int, dict[str, int]] = {}


def buckets_of(text: str, n_buckets: int) -> np.ndarray:
    words = WORDS.findall(text)
    known = _known.setdefault(n_buckets, {})
    out = list(map(known.get, words))
    if None in out:
        if len(known) > 500_000:
            known.clear()
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % n_buckets
                if len(w) <= 32:
                    known[w] = out[i]
    return np.array(out, np.int64)


def index_vectors(n_buckets: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries, from the bucket's number by a multiplicative hash."""
    h = (np.arange(1, n_buckets + 1, dtype=np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)[None, :NONZERO]) >> np.uint64(20)
    return (h % np.uint64(dim)).astype(np.int64), np.where((h >> np.uint64(30)) & np.uint64(1), 1, -1).astype(np.int64)


def context_sums(docs: DataFrame, n_buckets: int, dim: int) -> np.ndarray:
    """The context vectors, from all documents: partial sums in each task, then one sum for each bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(n_buckets, dim)
        total = np.zeros(n_buckets * dim)
        for b in batches:
            for text in b.column("text").to_pylist():
                w = buckets_of(text or "", n_buckets)
                for step in (1, 2):
                    left, right = w[:-step], w[step:]
                    if not len(left):
                        continue
                    for k in range(NONZERO):
                        at = np.concatenate([left * dim + place[right, k], right * dim + place[left, k]])
                        np.add.at(total, at, np.concatenate([sign[right, k], sign[left, k]]).astype(float))
        grid = total.reshape(n_buckets, dim).astype(np.int64)
        used = np.flatnonzero(grid.any(axis=1))
        for k in range(0, len(used), 8192):
            part = used[k : k + 8192]
            yield pa.record_batch([pa.array(part, pa.int32()), *(pa.array(grid[part, d], pa.int64()) for d in range(dim))], names=["b", *(f"c{d}" for d in range(dim))])

    partial = docs.select("text").mapInArrow(rows, "b int, " + ", ".join(f"c{d} long" for d in range(dim)))
    out = np.zeros((n_buckets, dim))
    for r in partial.groupBy("b").agg(*(F.sum(f"c{d}").alias(f"c{d}") for d in range(dim))).toLocalIterator():
        out[r[0]] = r[1:]
    return out


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    return np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).astype(np.float32)


def pool(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean vector, mean product of neighbours' vectors, and log lengths of the document."""
    w = buckets_of(text, len(vectors))
    n, dim = len(w), vectors.shape[1]
    out = np.zeros(2 * dim + 3)
    if n:
        mean, near = np.zeros(dim), np.zeros(dim)
        for k in range(0, n, 65536):  # a very long text in parts
            v = vectors[w[k : k + 65537]]
            mean += v[:65536].sum(axis=0, dtype=np.float64)
            near += np.einsum("ij,ij->j", v[:-1], v[1:])
        out[:dim], out[dim : 2 * dim] = mean / n, near / max(1, n - 1)
        out[2 * dim :] = np.log1p(n) / 10, np.log1p(len(text)) / 10, len(np.unique(w)) / n
    return out


@dataclass
class Network:
    """Two layers, tanh between them; ``temperature`` divides the logits."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 120, seed: int = 7) -> Network:
    """Adam on shuffled batches, weight decay; the last fifth of the rows sets the temperature by its likelihood."""
    rng = np.random.default_rng(seed)
    own = max(1, len(x) * 4 // 5)
    mean, scale = x[:own].mean(axis=0), x[:own].std(axis=0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(own), max(1, own // 128)):
            a = (x[rows] - mean) / scale
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (1 - h**2)
            grads = [a.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    rest = slice(own, None) if len(x) - own >= 20 else slice(None)
    logits = net.logits(x[rest])
    loss = lambda temp: np.mean(np.logaddexp(0, -(2 * y[rest] - 1) * logits / temp))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(features: DataFrame, labels: DataFrame, max_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_train`` labelled documents outside the held-out fold, those with the smallest hashes.

    A bound on the hash, from the number of labels, leaves about a fifth more than asked for; only these are joined, by
    broadcast, and sorted, so about ``max_train`` rows reach the driver in all.
    """
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    marks = marks.select("doc_id", "low", F.xxhash64("doc_id").alias("at"))
    share = max_train * 1.2 / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.col("at") < int(-(1 << 63) + share * (1 << 64)))
    taken = features.join(F.broadcast(marks), "doc_id").orderBy("at", "doc_id", "x").limit(max_train).select("x", "low").collect()
    return np.array([r["x"] for r in taken]), np.array([r["low"] for r in taken], float)


def classify(docs: DataFrame, labels: DataFrame, *, n_buckets: int = 16384, dim: int = 32, max_train: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    spark: SparkSession = docs.sparkSession
    own = sources_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = spark.sparkContext.broadcast(unit_vectors(context_sums(own, n_buckets, dim)))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pool(t or "", vectors.value).astype(np.float32) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    features = written(own.mapInArrow(pooled, "doc_id long, x array<float>"), "quality-features")
    x, y = training_rows(features, labels, max_train)
    net = fit(x, y) if len(set(y.tolist())) == 2 else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
            score = np.round(net.score(flat.reshape(len(ids), -1)), 6) if net and ids else np.full(len(ids), 0.5)
            kinds = (pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32()))
            yield pa.record_batch([b.column("doc_id"), *kinds], names=["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")

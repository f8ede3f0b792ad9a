"""Whitening, byte-level BPE and valid-time enrichment against brute force."""

import datetime as dt
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basaltiq.llm import byte_bpe, sale_versions, whitening

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# Whitening


def _whitened(rows, k=4):
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([np.array(v, np.float32).astype(float) for _, v in whole])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in whole], n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u / np.sqrt(e), e / np.trace(cov)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    axes = rng.normal(size=(6, 6)) * np.array([[3.0], [2.0], [1.2], [0.7], [0.4], [0.2]])
    rows = [(k, (rng.normal(size=6) @ axes).tolist()) for k in range(80)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("nan")] * 6), (105, [float("inf")] + [0.0] * 5), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).repartition(5)
    got = whitening.whiten(df).collect()
    ids, n, deviation, whitened, explained = _whitened(rows)
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n} == {80}
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(4):
        mine = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ whitened[:, c])
        assert np.abs(sign * mine - whitened[:, c]).max() < 1e-9
        assert all(abs(by[i, c + 1].explained / explained[c] - 1) < 1e-9 for i in ids)
    assert all(int(by[i, 1].deviation) == int(d) for i, d in zip(ids, deviation, strict=True))
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).collect() == [] == whitening.whiten(make([(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, 2.0])])).collect()
    # Rank one: one component; a vector of another length has no place.
    got = whitening.whiten(make([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [5.0])])).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(1, 1), (2, 1), (3, 1)]
    # Squares beyond 38 digits are null, nothing fails.
    far = whitening.whiten(make([(1, [3e38, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 5.0])])).collect()
    assert {r.vec_id: r.deviation is None for r in far} == {1: True, 2: False, 3: False}


# Byte-level BPE


TEXTS = [None, "", "a", "   　 x\t\n\n  y ", "<|endoftext|> don't we'll I'M 12345 ½ é漢字\U0001f642\U0001f3fd \u0085z ​", "a" * 940, " " * 300, "ZQxjkvbw" * 60, "\x00\x1f\x7f �"]


def _coded(spark, texts, **options):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string").drop("ids").withColumn("word", F.lit(1))
    coded, ids = byte_bpe.encode(docs, ranks=RANKS, pattern=public_tokenizers.PATTERN, **options), F.col("ids")
    made = coded.select("doc_id", "ids", byte_bpe.decode(ids, ranks=RANKS).alias("back"), F.sha2(byte_bpe.little_endian(ids, ranks=RANKS), 256).alias("sha"))
    return {r.doc_id: (r.ids, bytes(r.back), r.sha) for r in made.collect()}


@pytest.mark.parametrize("frequent", [0, byte_bpe.FREQUENT])
def test_bpe_agrees_with_the_library(spark, frequent):
    rng = random.Random(3)
    made = ["".join(rng.choice("abehinrst  '.,\n\t019ß中\U0001f600") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = _coded(spark, TEXTS + made, frequent=frequent)
    for k, text in enumerate(TEXTS + made):
        want = library.encode_ordinary(text or "")
        assert got[k] == (want, (text or "").encode(), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()), text


def test_bpe_of_no_texts(spark):
    assert _coded(spark, []) == {}


def test_java_pattern():
    assert byte_bpe.java_pattern(r"[^\s\p{L}]|\S") == rf"[^{byte_bpe.SPACE}\p{{L}}]|[^{byte_bpe.SPACE}]"
    with pytest.raises(ValueError):
        byte_bpe.java_pattern(r"[\S]")


# Valid-time enrichment


def _enriched(sales, changes):
    """The contract, batch by batch, client by client."""
    day = lambda t: (t.date() - dt.date(1970, 1, 1)).days
    batch = lambda d: min(7, max(0, (d - 19723) * 8 // 152))
    sales = [(batch(day(s[3])), s) for s in sales]
    changes = [(batch(day(c[4]) + zlib.crc32(str(c[0]).encode()) % 4), c) for c in set(changes) if c[4]]
    slack, out, waiting, held = dt.timedelta(hours=12), [], [], {}
    order = lambda c: (c[4], c[2], c[0])

    def emit(some, b):
        for s in some:
            own = held.get(s[1], []) if s[1] is not None else []
            found = max((c for c in own if s[2] is not None and c[4] <= s[2]), key=order, default=None)
            out.append(("sale", s[0], b, len(own), *((found[0], None if found[5] is None else int(np.floor(100 * found[5] + 0.5)), found[3]) if found else (None, None, None))))

    for b in range(8):
        marks = [max((x for k, x in found if k < b and x), default=None) for found in ([(k, s[2]) for k, s in sales], [(k, c[4]) for k, c in changes])]
        ws, wc = (m - slack if m else None for m in marks)
        upto = min(ws, wc) if ws and wc else None
        for k, c in changes:
            if k == b:
                if wc and c[4] < wc:
                    out.append(("late", c[0], b, None, None, None, None))
                else:
                    held.setdefault(c[1], []).append(c)
        waiting += [s for k, s in sales if k == b]
        ready = [s for s in waiting if s[2] is None or (upto and s[2] < upto)]
        emit(ready, b)
        waiting = [s for s in waiting if s not in ready]
        for own in held.values():
            passed = sorted((c for c in own if upto and c[4] <= upto), key=order)
            for c in passed[:-1]:
                own.remove(c)
    emit(waiting, 8)
    return out


SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double"


def _tables(spark, sales, changes):
    clash = {"shard": F.lit(1), "at": F.lit("x"), "block": F.lit(None), "kind": F.lit("k")}
    return spark.createDataFrame(sales, SALES).withColumns(clash), spark.createDataFrame([(*c,) for c in changes], CHANGES).withColumns(clash)


@pytest.mark.parametrize("block_rows", [7, 20_000])
def test_sale_versions(spark, block_rows):
    """Small blocks make several of them, and shards of the hot client."""
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rng.randrange(120 * 86400) // 1800 * 1800)
    who = lambda: rng.choice([7, 7, 7, 1, 2, 3, 4])
    changes = [(k, who(), rng.randint(0, 2), rng.choice(["I", "U", "D", None]), None if k % 19 == 0 else at(), None if k % 7 == 0 else round(rng.uniform(-9, 99), 2)) for k in range(120)]
    changes += changes[:9]
    sales = []
    for k in range(150):
        sold = at()
        sales.append((k, None if k % 13 == 0 else who(), None if k % 17 == 0 else sold, sold + dt.timedelta(hours=rng.choice([0, 0, 5, 90]))))
    sold, changed = _tables(spark, sales, changes)
    got = sale_versions.enrich_sales(sold, changed, block_rows=block_rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_enriched(sales, changes), key=str)


def test_sale_versions_of_empty_tables(spark):
    at = dt.datetime(2024, 2, 1)
    sold, changed = _tables(spark, [(1, 5, at, at)], [])
    assert [tuple(r) for r in sale_versions.enrich_sales(sold, changed).collect()] == [("sale", 1, 8, 0, None, None, None)]
    none, _ = _tables(spark, [], [])
    assert sale_versions.enrich_sales(none, changed).collect() == []


def test_bisect_and_prune():
    a = lambda *v: np.array(v, np.int64)
    held = {"client": a(1, 1, 1, 3), "at": a(2, 4, 4, 1)}
    place, n = sale_versions.bisect_versions(held, a(1, 1, 1, 2, 3, 3), a(1, 4, 3, 9, 1, 0))
    assert place.tolist() == [-1, 2, 0, -1, 3, -1] and n.tolist() == [3, 3, 3, 0, 1, 1]
    assert sale_versions.pruned(held, 4)["at"].tolist() == [4, 1] and sale_versions.pruned(held, 3)["at"].tolist() == [2, 4, 4, 1]


def test_bpe_words_are_merged_together():
    """Words of every length, those of several bytes in one matrix and long ones from a heap, against the library; a task's later batches find words that it holds."""
    rng = random.Random(5)
    ranks = byte_bpe.read_ranks(RANKS)
    words = sorted({"".join(rng.choice("abcdetionß漢Q") for _ in range(rng.randint(1, 70))).encode() for _ in range(2000)} | {b"ab" * 3000, b"a"})
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    want, held = [library.encode_ordinary(w.decode()) for w in words], {}
    merges = byte_bpe.Merges(ranks)
    assert merges.ids(words, held, 100) == want and len(held) == 100
    assert merges.ids(words[::-1], held, 100) == want[::-1] and merges.ids([], held, 0) == []


def test_bpe_of_runs_of_texts(spark, monkeypatch):
    """A run of texts, not a batch, is worked on at once; null ids stay null."""
    monkeypatch.setattr(byte_bpe, "ENTRIES", 3)
    lists = pa.array([[1, 2], None, [3], [], [4, 5, 6, 7], [8]], pa.list_(pa.int32()))
    assert [(r.start, r.stop) for r in byte_bpe._runs(lists)] == [(0, 4), (4, 5), (5, 6)]
    of = lambda some: (pa.py_buffer(some.astype("<u4")), 4 * np.arange(len(some) + 1))
    want = [None if x is None else np.array(x, "<u4").tobytes() for x in lists.to_pylist()]
    assert byte_bpe._binaries(lists, of).to_pylist() == want and byte_bpe._binaries(lists[1:5], of).to_pylist() == want[1:5]

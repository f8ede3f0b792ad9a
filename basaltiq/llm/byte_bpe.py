"""Byte-level BPE: Spark cuts texts into words, numpy merges the different words of many texts at once.

A text is cut into words by the vocabulary's pattern. The words of a run of texts are numbered, each different one is merged once,
and the ids are laid out in the texts' order; texts are never shuffled and no word is sent anywhere. Short words are rows of a
matrix, at first one byte to a column. A step merges in every row the leftmost of the adjacent pairs of least rank; rows without
a rank leave. Words of more than ``LONGEST`` bytes take their merges from a heap, so n bytes without a break cost n log n. A word
that has a rank itself is not merged. A piece's rank is its id. The ranks of pieces and of pairs of pieces (some 2 MB) go with the
tasks. Decoding looks the pieces of ids up and concatenates their bytes.

Defined results. Null and empty texts have no ids. Repeated rows are each encoded. Empty tables give no rows. Strings of
special tokens are ordinary text. Extra columns are ignored, unless asked for. Letters are those of Java's Unicode tables.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Merged words that a task holds for its next runs, and the bytes of the longest word that is a row of a matrix.
FREQUENT, LONGEST = 1 << 16, 64
#: Words, or ids, of a run of texts that a task works on at once.
ENTRIES = 1 << 17
#: Rows of a matrix.
ROWS = 1 << 15
NONE = np.iinfo(np.int64).max
#: Java's ``\s`` is ASCII only; this is Unicode's white space, as the pattern means it.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def java_pattern(pattern: str) -> str:
    """The pattern with white space spelled out. Classes of white space, and of what is not, may stand in or out of brackets."""
    inside, out, k = False, [], 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\s", r"\S"):
            if two == r"\S" and inside:
                raise ValueError("a class of other than white space within brackets has no plain spelling")
            out.append(SPACE if inside else f"[{'^' * (two == r'\S')}{SPACE}]")
            k += 2
            continue
        if two[0] == "\\":
            out.append(two)
            k += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out.append(two[0])
        k += 1
    return "".join(out)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a piece in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Merges:
    """The ranks of pieces; and of pairs of pieces by their ids, that is the rank of their joined bytes, as sorted keys."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.ranks, self.single = ranks, np.array([ranks[bytes([k])] for k in range(256)])
        keys = sorted(found)
        # The last key is that of no pair, so that every search ends at a key.
        self.keys, self.joined = np.array([*keys, NONE]), np.array([*map(found.get, keys), NONE])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, ``NONE`` where there is none; the id -1 stands for no piece."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.joined[at], NONE)

    def short(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words, each a row."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        columns, live = np.arange(max(2, sizes.max())), np.arange(len(words))
        parts = np.full((len(words), len(columns)), -1)
        parts[columns < sizes[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks, made = self.rank(parts[:, :-1], parts[:, 1:]), parts.copy()
        while len(live):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(live)), at]
            merges = least != NONE
            if not merges.all():
                made[live[~merges]] = parts[~merges]
                live, parts, ranks, at, least = live[merges], parts[merges], ranks[merges], at[merges], least[merges]
            i, place = np.arange(len(live)), at[:, None]
            parts[:, :-1], parts[:, -1] = np.where(columns[:-1] > place, parts[:, 1:], parts[:, :-1]), -1
            ranks[:, :-1], ranks[:, -1] = np.where(columns[:-2] >= place, ranks[:, 1:], ranks[:, :-1]), NONE
            parts[i, at] = least
            ranks[i, at] = self.rank(least, parts[i, at + 1])
            i, at, least = i[at > 0], at[at > 0], least[at > 0]
            ranks[i, at - 1] = self.rank(parts[i, at - 1], least)
        return [row[:n] for row, n in zip(made.tolist(), (made >= 0).sum(1).tolist(), strict=True)]

    def long(self, word: bytes) -> list[int]:
        """The ids of one word: pairs wait in a heap by rank and place; one whose pieces have changed since is passed over."""
        parts = self.single[np.frombuffer(word, np.uint8)]
        first = self.rank(parts[:-1], parts[1:]).tolist()
        parts, after, before = parts.tolist(), [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        heap = [(rank, k, parts[k], parts[k + 1]) for k, rank in enumerate(first) if rank != NONE]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            if parts[k] != left or after[k] < 0 or parts[after[k]] != right:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = rank, -1, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0:
                    at = self.keys.searchsorted(pair := parts[a] << 32 | parts[b])
                    if self.keys[at] == pair:
                        heapq.heappush(heap, (int(self.joined[at]), a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def ids(self, words: list[bytes], held: dict[bytes, list[int]], most: int) -> list[list[int]]:
        """The ids of different words; up to ``most`` of those that had to be merged are added to ``held``."""
        made: dict[bytes, list[int]] = {}
        new = sorted((w for w in words if w not in self.ranks and w not in held), key=len)
        short = [w for w in new if len(w) <= LONGEST]
        for k in range(0, len(short), ROWS):
            made.update(zip(some := short[k : k + ROWS], self.short(some), strict=True))
        made.update((w, self.long(w)) for w in new[len(short) :])
        found = [[self.ranks[w]] if w in self.ranks else held[w] if w in held else made[w] for w in words]
        for w in made:
            if len(held) >= most:
                break
            held[w] = made[w]
        return found


def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _runs(lists: pa.ListArray) -> Iterator[slice]:
    """Runs of lists of ``ENTRIES`` entries together at most, or of one list."""
    offsets, k = lists.offsets.to_numpy(), 0
    while k < len(lists):
        n = max(1, int(np.searchsorted(offsets, offsets[k] + ENTRIES, "right")) - 1 - k)
        yield slice(k, k + n)
        k += n


def encode(docs: DataFrame, *, ranks: str, pattern: str, keep: tuple[str, ...] = (), frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, ids array<int>`` and the columns of ``keep``, for every row of ``docs (doc_id, text)``; ``ranks`` is the path of a rank file, read by the driver."""
    merges = Merges(read_ranks(ranks))
    names = ["doc_id", "ids", *keep]

    def coded(words: pa.ListArray, held: dict[bytes, list[int]]) -> pa.ListArray:
        numbered = words.flatten().dictionary_encode()
        found = merges.ids(numbered.dictionary.cast(pa.binary()).to_pylist(), held, frequent)
        sizes, at = np.fromiter(map(len, found), np.int64, len(found)), numbered.indices
        lists = pa.ListArray.from_arrays(pa.array(_ends(sizes), pa.int32()), pa.array(np.fromiter(chain.from_iterable(found), np.int32), pa.int32()))
        starts = words.offsets.to_numpy()
        ends = _ends(sizes[at.to_numpy()])[starts - starts[0]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.take(at).flatten())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for run in _runs(batch.column(1)):
                doc_id, words, *rest = (c[run] for c in batch.columns)
                yield pa.RecordBatch.from_arrays([doc_id, coded(words, held), *rest], names)

    made = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), *(docs.schema[c] for c in keep)])
    return docs.select("doc_id", _words(F.col("text"), pattern).alias("ids"), *keep).mapInArrow(rows, made)


def _binaries(ids: pa.ListArray, of: Callable[[np.ndarray], tuple[pa.Buffer, np.ndarray]]) -> pa.Array:
    """A binary for each list, null for null; ``of`` gives the bytes of ids and where those of each id begin, and the end."""
    made = [pa.array([], pa.binary())]
    for run in _runs(ids):
        offsets = ids[run].offsets.to_numpy()
        data, ends = of(ids.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False))
        made.append(pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets - offsets[0]].astype(np.int32)), data]))
    return pc.if_else(ids.is_valid(), pa.concat_arrays(made), pa.scalar(None, pa.binary()))


def decode(ids: Column, *, ranks: str) -> Column:
    """The bytes that the ids stand for, in a row."""
    by_id = {rank: piece for piece, rank in read_ranks(ranks).items()}
    pieces = pa.array([by_id.get(k, b"") for k in range(max(by_id) + 1)], pa.binary())
    sizes = pc.binary_length(pieces).to_numpy().astype(np.int64)

    def joined(ids: pa.Array) -> pa.Array:
        return _binaries(ids, lambda some: (pieces.take(pa.array(some, pa.int32())).buffers()[2], _ends(sizes[some])))

    return F.arrow_udf(joined, "binary")(ids)


def little_endian(ids: Column, *, ranks: str) -> Column:
    """The ids as unsigned 32-bit integers in a row, the lowest byte first."""

    def laid(ids: pa.Array) -> pa.Array:
        return _binaries(ids, lambda some: (pa.py_buffer(some.astype("<u4")), 4 * np.arange(len(some) + 1)))

    return F.arrow_udf(laid, "binary")(ids)

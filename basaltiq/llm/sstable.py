"""Sorted-string-table shards of token ids, keyed by document identifier.

File layout, integers little-endian:

* blocks: entries in key order, each ``varint shared, varint unshared, varint value length, key suffix, value``; every
  ``RESTART``-th entry shares nothing, and the block ends with the restart offsets, their number and a CRC-32; stored
  as one zstd frame each;
* index: for each block its last key, offset, stored length and entries;
* Bloom filter over all keys, two 64-bit hashes combined ``k`` times;
* footer of fixed length: places of index and filter, entries, version and magic.

A lookup asks the filter, searches the index by bisection, reads one block, searches its restarts by bisection and
scans at most ``RESTART`` entries. Keys are order-preserving: a null id is the empty key and comes first.

Defined results: null and empty texts are the end id alone; rows that repeat a key are neighbours and all kept, and a
lookup gives all of them; no documents give no shards and no rows.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltiq.llm.common import dealt_by_file, fresh_path, sources_of, written
from basaltiq.llm.files import new_file, open_in, open_out
from basaltiq.llm.tokens import encoder, parts

MAGIC, VERSION, RESTART = b"BSST", 1, 16
#: Rows that a reader gives at once.
BATCH = 4096
FOOTER = struct.Struct("<QQQQQIB3x4s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """At ``bits`` bits a key, ``0.7 * bits`` probes; 10 bits give about one false answer in a hundred."""

    def __init__(self, data: bytearray, probes: int) -> None:
        self.data, self.probes = data, probes

    @classmethod
    def of(cls, keys: list[bytes], bits: int = 10) -> Bloom:
        made = cls(bytearray(max(8, len(keys) * bits // 8 + 1)), max(1, round(bits * 0.7)))
        for k in keys:
            for i in made._places(k):
                made.data[i >> 3] |= 1 << (i & 7)
        return made

    def _places(self, key: bytes) -> Iterator[int]:
        a, b, n = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, 1) | 1, len(self.data) * 8
        return (((a + k * b) & 0xFFFFFFFFFFFFFFFF) % n for k in range(self.probes))

    def __contains__(self, key: bytes) -> bool:
        return all(self.data[i >> 3] >> (i & 7) & 1 for i in self._places(key))


class TableWriter:
    """Takes entries in key order and writes blocks as they fill; memory: one block, the index and the keys."""

    def __init__(self, uri: str, block_bytes: int = 64 << 10) -> None:
        self.uri, self.first, self.last, self.entries, self.offset = uri, None, None, 0, 0
        self._out, self._block_bytes = open_out(uri), block_bytes
        self._zstd = zstandard.ZstdCompressor(level=3)
        self._index: list[tuple[bytes, int, int, int]] = []
        self._keys: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self._block, self._restarts, self._in_block, self._last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self._keys and key < self._keys[-1]:
            raise ValueError("keys must come in order")
        if self._in_block % RESTART:
            shared = next((i for i, (x, y) in enumerate(zip(key, self._last, strict=False)) if x != y), min(len(key), len(self._last)))
        else:
            shared = 0
            self._restarts.append(len(self._block))
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first = key if self.first is None else self.first
        self._last = self.last = key
        self._keys.append(key)
        self.entries += 1
        self._in_block += 1
        if len(self._block) >= self._block_bytes:
            self._flush()

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self.offset += len(data)

    def _flush(self) -> None:
        if not self._in_block:
            return
        raw = bytes(self._block) + struct.pack(f"<{len(self._restarts)}II", *self._restarts, len(self._restarts))
        stored = self._zstd.compress(raw + struct.pack("<I", zlib.crc32(raw)))
        self._index.append((self._last, self.offset, len(stored), self._in_block))
        self._write(stored)
        self._new_block()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) + _varint(c) for k, o, n, c in self._index)
        bloom = Bloom.of(self._keys)
        at = self.offset
        self._write(index)
        self._write(bytes(bloom.data))
        self._write(FOOTER.pack(at, len(index), at + len(index), len(bloom.data), self.entries, zlib.crc32(index + bytes(bloom.data)), bloom.probes, MAGIC))
        self._out.close()


class TableReader:
    def __init__(self, uri: str) -> None:
        self._in = open_in(uri)
        size = self._in.size()
        at, n, bloom_at, bloom_n, self.entries, crc, probes, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        index, bloom = self._read(at, n), self._read(bloom_at, bloom_n)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError(f"{uri} is no whole table")
        self.bloom = Bloom(bytearray(bloom), probes)
        self._last_keys: list[bytes] = []
        self._places: list[tuple[int, int, int]] = []
        at = 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self._last_keys.append(index[at : at + n])
            at += n
            place = []
            for _ in range(3):
                x, at = _read_varint(index, at)
                place.append(x)
            self._places.append(tuple(place))
        self._zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        offset, n, _ = self._places[k]
        raw = self._zstd.decompress(self._read(offset, n))
        if zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
            raise ValueError("a block is damaged")
        count = int.from_bytes(raw[-8:-4], "little")
        end = len(raw) - 8 - 4 * count
        return raw[:end], list(struct.unpack(f"<{count}I", raw[end:-8]))

    @staticmethod
    def _scan(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + n]
            at += rest + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self._places)):
            yield from self._scan(self._block(k)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """The values of ``key``, in the order in which they were added."""
        found: list[bytes] = []
        if key not in self.bloom:
            return found
        for k in range(bisect.bisect_left(self._last_keys, key), len(self._places)):
            data, restarts = self._block(k)
            first = lambda at, data=data: next(self._scan(data, at))[0]
            for this, value in self._scan(data, restarts[max(0, bisect.bisect_left(restarts, key, key=first) - 1)]):
                if this > key:
                    return found
                if this == key:
                    found.append(value)
        return found

    def close(self) -> None:
        self._in.close()


def write_shards(docs: DataFrame, *, tokenizer: str, end_id: int, shard_bytes: int = 64 << 20, block_bytes: int = 64 << 10) -> DataFrame:
    """Write shards in ascending ``doc_id`` order; the manifest ``path, first, last, entries, n_ids`` is a written table.

    Ranges are cut by id and text, so that rows which repeat one id do not meet in one task.
    """
    folder = fresh_path(docs.sparkSession, "sstable")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, n_ids, done = encoder(tokenizer).encode, None, 0, []

        def close() -> None:
            writer.close()
            done.append((writer.uri, writer.first, writer.last, writer.entries, n_ids))

        for b in batches:
            doc_ids, at = b.column("doc_id").to_pylist(), 0
            for texts in parts(b.column("text")):
                ids, ends = encode(texts, end_id)
                # Ids below 65536 take two bytes; the first byte tells the width.
                mark, width = (b"\2", "<u2") if ids.max() < 65536 else (b"\4", "<u4")
                ids = ids.astype(width)
                for doc_id, first, end in zip(doc_ids[at : at + len(texts)], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if writer is None:
                        writer, n_ids = TableWriter(new_file(folder, ".sst"), block_bytes), 0
                    n_ids += end - first
                    writer.add(key_of(doc_id), mark + ids[first:end].tobytes())
                    if writer.offset >= shard_bytes:
                        close()
                        writer = None
                at += len(texts)
        if writer:
            close()
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=["path", "first", "last", "entries", "n_ids"])

    own = sources_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ("doc_id", F.xxhash64("text"))
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(rows, "path string, first binary, last binary, entries long, n_ids long"), "sstable-manifest")


def read_values(value: bytes) -> np.ndarray:
    return np.frombuffer(value[1:], "<u2" if value[0] == 2 else "<u4").astype("<u4")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every entry; ``start`` counts the ids of all entries before it.

    The running sum goes over the manifest, one row for each shard of 64 MB.
    """
    before = Window.orderBy("first", "last", "path").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                table, made = TableReader(path), []
                for key, value in table:
                    ids = read_values(value)
                    made.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(made) == BATCH:
                        yield _rows_of(made)
                        made = []
                table.close()
                yield _rows_of(made)

    return dealt_by_file(based).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows_of(made: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([m[k] for m in made], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

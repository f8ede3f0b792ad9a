"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame for each record.

The writer trains a dictionary for each archive on its first ``SAMPLE_BYTES`` of payload (a fixed, documented bound;
the dictionary only changes the size) and rolls archives at ``archive_bytes``. Records with equal payloads of at least
``min_bytes`` bytes are told apart by digest: the one with the largest ``page_id`` is the response, the others are
revisits without payload. The reader takes the dictionary from the skippable frame, decodes frame by frame in a stream,
and checks version line, mandatory headers, lengths, block digest and the closing empty lines.

Only (page_id, digest) is grouped and joined; pages are shuffled once, by page_id. Defined results: a null html is
empty; rows that repeat a page_id with one payload give the same record each; a null page_id is written with an empty
record id and is a response of its own, since nothing can refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import dealt_by_file, fresh_path, sources_of, written
from basaltiq.llm.files import new_file, open_in, open_out

#: Fixed values of the WARC and Zstandard formats.
WARC_VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
#: A window size of the reader's decompressor; larger frames are refused rather than held.
MAX_WINDOW = 1 << 31


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        WARC_VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and block of one record; ValueError if it is not valid."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != WARC_VERSION:
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon:
            raise ValueError(f"no header field: {line!r}")
        fields[name.strip().lower()] = value.strip()
    if lacking := [m for m in MANDATORY if m not in fields]:
        raise ValueError(f"lacks {', '.join(lacking)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, {n} announced")
    block = rest[:n]
    if (d := fields.get("warc-block-digest")) and d != f"sha1:{digest_of(block)}":
        raise ValueError("block digest differs")
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest") != f"sha1:{digest_of(block)}":
        raise ValueError("payload digest differs")
    return fields, block


class ArchiveWriter:
    def __init__(self, uri: str, samples: list[bytes]) -> None:
        self.uri, self.records, self.size, self._out = uri, 0, 0, open_out(uri)
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
        except zstandard.ZstdError:  # too little to learn from
            trained = b""
        # A raw-content dictionary serves where none can be trained.
        raw = trained or (samples[0][:4096] if samples else b"") or b"<!DOCTYPE html><html>"
        self._zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
        self._write(DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(self._zstd.compress(data))
        self.records += 1

    def close(self) -> None:
        self._out.close()


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, one frame at a time."""
    source = open_in(uri)
    try:
        magic, n = (int.from_bytes(source.read(4), "little") for _ in range(2))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri} does not begin with a dictionary frame")
        content = source.read(n)
        if len(content) != n:
            raise ValueError(f"{uri} ends within its dictionary")
        if content[:4] == FRAME_MAGIC.to_bytes(4, "little"):  # the dictionary itself may be compressed
            content = zstandard.ZstdDecompressor().decompress(content)
        zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content), max_window_size=MAX_WINDOW)
        rest = b""
        while rest or (rest := source.read(1 << 20)):
            if len(rest) < 4:
                rest += source.read(1 << 20)
            if rest[:4] != FRAME_MAGIC.to_bytes(4, "little"):
                raise ValueError(f"{uri}: no frame where one should begin")
            frame, parts = zstd.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := source.read(1 << 20)):
                    raise ValueError(f"{uri} ends within a frame")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            yield parse(b"".join(parts))
    finally:
        source.close()


def _with_digests(pages: DataFrame) -> DataFrame:
    """``page_id, digest, n``: the payload's SHA-1 in hexadecimal, and its bytes."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))


def write_archives(pages: DataFrame, *, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write all pages; the manifest ``path, records, size`` is a written table."""
    folder = fresh_path(pages.sparkSession, "warc")
    rows = _with_digests(pages).where("page_id is not null")
    first = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    revisits = rows.where(F.col("n") >= min_bytes).join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = sources_of(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    joined = own.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((p, u, (h or "").encode("utf-8", "surrogatepass"), r) for b in batches for p, u, h, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True))
        done: list[ArchiveWriter] = []
        ahead: deque[tuple] = deque()
        while True:
            held = sum(len(row[2]) for row in ahead)
            while held < SAMPLE_BYTES and (row := next(made, None)):
                ahead.append(row)
                held += len(row[2])
            if not ahead:
                break
            archive = ArchiveWriter(new_file(folder, ".warc.zst"), [h for *_, h, r in ahead if r is None and h])
            while archive.size < archive_bytes and (row := ahead.popleft() if ahead else next(made, None)):
                archive.add(record(*row))
            archive.close()
            done.append(archive)
        yield pa.record_batch([pa.array([d.uri for d in done], pa.string()), pa.array([d.records for d in done], pa.int64()), pa.array([d.size for d in done], pa.int64())], names=["path", "records", "size"])

    return written(joined.mapInArrow(write, "path string, records long, size long"), "warc-manifest")


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"


def read_archives(manifest: DataFrame, *, with_html: bool = True) -> DataFrame:
    """Columns RECORDS of every record; ``html`` is null for revisits, and for all without ``with_html``."""

    def ident(value: str | None) -> int | None:
        number = value.removeprefix("<urn:page:").removesuffix(">") if value else ""
        return int(number) if number else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                made, held, count = [], 0, 0
                for head, block in read_archive(path):
                    html = block.decode("utf-8", "surrogatepass") if with_html and head["warc-type"] == "response" else None
                    made.append((ident(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"]), ident(head.get("warc-refers-to")), html))
                    held += len(block)
                    count += 1
                    if held >= 8 << 20 or len(made) == 4096:
                        yield pa.record_batch([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=names)
                        made, held = [], 0
                if count != expected:
                    raise ValueError(f"{path} has {count} records, {expected} were written")
                yield pa.record_batch([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=names)

    return dealt_by_file(manifest).mapInArrow(rows, RECORDS)


#: SQL has no base32: the hexadecimal digest's bits are cut into fives, each a letter of the base32 alphabet.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT hex, max(page_id) AS refers_to FROM p GROUP BY hex),
bits AS (
  SELECT hex, list_aggregate(list_transform(range(40), lambda i:
    right('0000' || bin(instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4)), 'string_agg', '') AS b
  FROM first),
names AS (
  SELECT hex, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (CASE WHEN substr(b, 5 * i + 1, 1) = '1' THEN 16 ELSE 0 END + CASE WHEN substr(b, 5 * i + 2, 1) = '1' THEN 8 ELSE 0 END
     + CASE WHEN substr(b, 5 * i + 3, 1) = '1' THEN 4 ELSE 0 END + CASE WHEN substr(b, 5 * i + 4, 1) = '1' THEN 2 ELSE 0 END
     + CASE WHEN substr(b, 5 * i + 5, 1) = '1' THEN 1 ELSE 0 END + 1)::INT, 1)), 'string_agg', '') AS digest
  FROM bits)
SELECT p.page_id, strlen(p.html) AS payload_bytes, names.digest AS payload_digest,
       CASE WHEN p.page_id = first.refers_to THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first.refers_to THEN first.refers_to END AS refers_to
FROM p JOIN first USING (hex) JOIN names USING (hex)
"""

"""WARC archives as zstandard: a dictionary in a leading skippable frame, one frame per record.

Writers run inside the tasks and put whole files into the shared folder; only files named in the
manifest (which is written by Spark, hence once per task that counted) are read back. The reader
streams a file, decodes one frame per record and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import as_bytes, cut_lineage, shuffle_partitions, map_batches, open_input, open_output, output_folder, ship_with_tasks

ship_with_tasks(__name__)

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")

LEAST_BYTES = 0  #: payloads below this are never revisits
FILE_BYTES = 64 << 20  #: an archive is closed when it has so many compressed bytes
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4 << 20, 16 << 10  #: what a file's dictionary is trained on
LEVEL = 3
MOST_RECORD_BYTES = 1 << 30  #: a longer record is taken for damage
DATE = "2024-01-01T00:00:00Z"  #: capture time of records whose input names none
_MANIFEST = "path string, records bigint, bytes bigint"
_RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


class ArchiveError(ValueError):
    """An archive that breaks the format; the text names the file and the record."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; ``refers_to`` makes it a revisit, which carries the head of the answer only."""
    digest = payload_digest(payload)
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes], where: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"{where}: bad header line {line[:80]!r}")
        out[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def decode_record(data: bytes, where: str = "record") -> dict:
    """The parts of a record, after checks of version, headers, lengths and digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not gap:
        raise ArchiveError(f"{where}: no {VERSION.decode()} head")
    fields = _fields(lines, where)
    missing = [k for k in REQUIRED if k not in fields]
    if missing or not fields["content-length"].isdigit():
        raise ArchiveError(f"{where}: bad or missing headers {missing}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{where}: Content-Length {length}, found {len(rest) - 4}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    answer = _fields(lines, where)
    if not status.startswith(b"HTTP/") or not gap or not answer.get("content-length", "").isdigit():
        raise ArchiveError(f"{where}: bad answer head")
    size, kind = int(answer["content-length"]), fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or payload_digest(payload) != digest:
            raise ArchiveError(f"{where}: payload of {len(payload)} bytes doesn't fit its length {size} and digest")
    elif kind != "revisit" or payload or "x-refers-to-page-id" not in fields:
        raise ArchiveError(f"{where}: bad record type {kind}")
    page_id, refers_to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {
        "page_id": None if page_id is None else int(page_id), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": None if refers_to is None else int(refers_to), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for the records of a file; empty where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes one archive; the first records are held back until the dictionary is trained."""

    def __init__(self, stream):
        self.stream, self.bytes, self.records, self._held, self._size, self._codec = stream, 0, 0, [], 0, None

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        words = trained(self._held)
        packed = zstandard.ZstdCompressor(level=19).compress(words) if words else b""
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        known = zstandard.ZstdCompressionDict(words) if words else None
        self._codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        for record in self._held:
            self._put(self._codec.compress(record))
        self._held = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self._codec:
            self._put(self._codec.compress(record))
            return
        self._held.append(record)
        self._size += len(record)
        if len(self._held) >= SAMPLE_RECORDS or self._size >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if not self._codec:
            self._start()
        self.stream.close()


def read_archive(stream, where: str = "archive", chunk: int = 1 << 16):
    """The records of an archive, one frame in memory at a time."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    packed = stream.read(size) if magic == DICTIONARY_FRAME else b""
    if magic != DICTIONARY_FRAME or len(packed) != size:
        raise ArchiveError(f"{where}: no dictionary frame in front")
    words = zstandard.ZstdDecompressor().decompress(packed) if packed.startswith(ZSTD_FRAME) else packed
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    rest, n = b"", 0
    while rest or (rest := stream.read(chunk)):
        frame, parts, total = codec.decompressobj(), [], 0
        try:
            while True:
                parts.append(frame.decompress(rest))
                total += len(parts[-1])
                if frame.eof or total > MOST_RECORD_BYTES:
                    break
                rest = stream.read(chunk)
                if not rest:
                    raise ArchiveError(f"{where}, record {n}: cut off")
        except zstandard.ZstdError as error:
            raise ArchiveError(f"{where}, record {n}: {error}") from error
        if not frame.eof:
            raise ArchiveError(f"{where}, record {n}: longer than {MOST_RECORD_BYTES} bytes")
        rest = frame.unused_data
        yield decode_record(b"".join(parts), f"{where}, record {n}")
        n += 1


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, refers_to. Pages with equal payloads (by SHA-256) of ``least_bytes`` or
    more revisit the one with the largest page_id. Payloads are shuffled by page, not by digest:
    a payload that a third of all pages share never meets in one task."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    keys = cut_lineage(pages.where(F.octet_length("html") >= least_bytes).select("page_id", "digest"), "digests")
    largest = cut_lineage(keys.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n"), "largest")
    again = keys.join(largest, "digest").where("page_id < largest OR (page_id IS NULL AND largest IS NOT NULL)").distinct()
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), F.col("largest").alias("refers_to"))
    on = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    return pages.join(again, on, "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) and returns the manifest (path, records, bytes),
    which is itself written: reading it never writes an archive again."""
    def run(batches):
        writer, path, done = None, "", []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "refers_to")]
            for payload, page_id, url, refers_to in zip(as_bytes(batch.column("html")), *columns):
                if writer is None:
                    stream, path = open_output(folder, "part")
                    writer = ArchiveWriter(stream)
                writer.add(encode_record(page_id, url, payload, refers_to))
                if writer.bytes >= file_bytes:
                    writer.close()
                    done.append((path, writer.records, writer.bytes))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, writer.records, writer.bytes))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut_lineage(map_batches(pages, run, _MANIFEST), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that a manifest names, one task per group of files."""
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with open_input(path) as stream:
                    for record in read_archive(stream, path):
                        if not with_payload:
                            record["payload"] = None
                        rows.append(record)
                        size += len(record["payload"] or b"") + 100
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return map_batches(manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession)), run, _RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, one row per page.

    A null html is the empty payload, a null url leaves out WARC-Target-URI, a null page_id leaves
    out its header and counts as smaller than any number. Rows that repeat both page_id and payload
    are alike: responses where theirs is the largest page_id, else revisits. Very long pages are one
    record each. Other columns are ignored; an empty table writes no archive.
    """
    folder = output_folder(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages), folder)
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL_DIGIT = "strpos('0123456789abcdef', h[{} + 1]) - 1"
ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((({_SQL_DIGIT.format('5 * i // 4')}) * 16 + ({_SQL_DIGIT.format('5 * i // 4 + 1')})) >> (3 - 5 * i % 4)) & 31) + 1]), '') AS payload_digest,
 CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < largest THEN largest END AS refers_to FROM m"""

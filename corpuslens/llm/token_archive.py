"""Token ids in a seekable binary format.

A file is a row of independent zstandard frames, each with whole documents, and ends with a seek
table (a skippable frame with the sizes and the checksum of every frame). A frame holds the number
of its documents, the bytes of an id, the doc_ids, the lengths, and the ids. A reader opens the
seek table, then decompresses only the frames that it needs. Files are written inside the tasks in
ascending doc_id order; the index (one row per document) and the manifest (one row per file) are
Spark tables.
"""

from __future__ import annotations

import json
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.llm.common import as_bytes, cut_lineage, shuffle_partitions, map_batches, open_input, open_output, output_folder, ship_with_tasks, text_hash

ship_with_tasks(__name__)

# Fixed values of the format.
SEEK_TABLE_FRAME = 0x184D2A5E
SEEK_TABLE_END = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

FRAME_IDS = 1 << 16  #: a frame is closed when it has so many ids; a document is never cut
FILE_BYTES = 64 << 20  #: a file is closed when it has so many bytes
LEVEL = 3
CACHE_WORDS = 1_000_000  #: pieces of text whose ids a Python worker keeps
END_ID = 1
_INDEX = "part bigint, file bigint, path string, frame bigint, place bigint, doc_id bigint, n_tokens bigint"
#: Fixed value: the text pipeline for which a lone word may go straight to the model.
WORD_PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


#: Marks that are one run of their own behind letters (not the apostrophe, which may join them).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _printable_bytes() -> dict[int, str]:
    """What byte-level models write for a byte: itself where it prints, else a character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts.

    A tokenizer with the pipeline above drops white space, never joins across it and ignores case,
    so a text is cut at ASCII white space and each distinct piece is encoded once and kept. Texts
    that may hold special tokens, and all texts under any other pipeline, are encoded as they are.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        pipeline = json.loads(spec)
        self.by_word = all(pipeline.get(k) == v for k, v in WORD_PIPELINE.items()) and not pipeline["model"].get("unk_token")
        self.plain_specials = all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in pipeline.get("added_tokens") or ())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.kept: dict[bytes, bytes] = {}
        self.byte_names = _printable_bytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a run of letters, or None where the pipeline would change or cut it."""
        if not word.isalpha() or max(word) >= "\u0250" or word != word.lower() or not unicodedata.is_normalized("NFC", word):
            return None
        name = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_names)
        return array(self.code, [t.id for t in self.model.tokenize(name)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        letters = text.rstrip(MARKS)
        if letters != text and letters.isalpha():  # the pipeline cuts letters from the marks after them
            return self._ids(letters.encode()) + self._ids(text[len(letters):].encode())
        ids = self._word(text)
        return self._whole(text) if ids is None else ids

    def _ids(self, piece: bytes) -> bytes:
        ids = self.kept.get(piece)
        if ids is None:
            if len(self.kept) >= CACHE_WORDS:
                self.kept.clear()
            ids = self.kept[piece] = self._piece(piece)
        return ids

    def encode(self, text: bytes) -> bytes:
        if not self.by_word or not self.plain_specials or b"<|" in text:
            return self._whole(text.decode())
        pieces = text.lower().split()
        found = list(map(self.kept.get, pieces))
        if None in found:
            found = [self._ids(p) if ids is None else ids for p, ids in zip(pieces, found)]
        return b"".join(found)


def _encoder(name: str, spec) -> Encoder:
    store = sys.__dict__.setdefault("_text_encoders", {})
    if name not in store:
        store.clear()
        store[name] = Encoder(spec())
    return store[name]


class FrameWriter:
    """Writes documents in frames and closes the file with its seek table."""

    def __init__(self, stream, itemsize: int):
        self.stream, self.itemsize, self.codec = stream, itemsize, zstandard.ZstdCompressor(level=LEVEL)
        self.table, self.bytes, self.docs, self.held = [], 0, [], 0

    def add(self, doc_id: int, ids: bytes) -> tuple[int, int]:
        """(frame, place in the frame) of the document."""
        at = len(self.table), len(self.docs)
        self.docs.append((doc_id, ids))
        self.held += len(ids) // self.itemsize
        if self.held >= FRAME_IDS:
            self.flush()
        return at

    def flush(self) -> None:
        if not self.docs:
            return
        data = b"".join([
            struct.pack("<II", len(self.docs), self.itemsize), np.array([d for d, _ in self.docs], "<i8").tobytes(),
            np.array([len(i) // self.itemsize for _, i in self.docs], "<u8").tobytes(), *[i for _, i in self.docs]])
        packed = self.codec.compress(data)
        self.stream.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.bytes += len(packed)
        self.docs, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<III", *row) for row in self.table)
        body += struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEK_TABLE_END)
        self.stream.write(struct.pack("<II", SEEK_TABLE_FRAME, len(body)) + body)
        self.stream.close()


def seek_table(stream, size: int) -> list[tuple[int, int, int, int]]:
    """(offset, packed bytes, bytes, checksum) of each frame of a file of ``size`` bytes."""
    stream.seek(max(0, size - 9))
    tail = stream.read(9)
    frames, flags, magic = struct.unpack("<IBI", tail) if len(tail) == 9 else (0, 0, 0)
    length = frames * 12 + 9
    if magic != SEEK_TABLE_END or flags != HAS_CHECKSUMS or size < length + 8:
        raise ValueError("no seek table at the end")
    stream.seek(size - length - 8)
    data = stream.read(length + 8)
    if struct.unpack("<II", data[:8]) != (SEEK_TABLE_FRAME, length):
        raise ValueError("broken seek table")
    out, at = [], 0
    for n in range(frames):
        row = struct.unpack_from("<III", data, 8 + 12 * n)
        out.append((at, *row))
        at += row[0]
    if at != size - length - 8:
        raise ValueError("the seek table doesn't fit the file")
    return out


def read_frame(stream, row: tuple[int, int, int, int]):
    """(doc_ids, list of id arrays) of one frame, its checksum verified."""
    at, packed, size, checksum = row
    stream.seek(at)
    data = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=size)
    if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError(f"the frame at {at} doesn't fit its checksum")
    docs, itemsize = struct.unpack_from("<II", data)
    doc_ids = np.frombuffer(data, "<i8", docs, 8)
    lengths = np.frombuffer(data, "<u8", docs, 8 + 8 * docs)
    ids = np.frombuffer(data, f"<u{itemsize}", offset=8 + 16 * docs)
    ends = np.cumsum(lengths).astype(np.int64)
    return doc_ids, [ids[e - int(n):e] for e, n in zip(ends, lengths)]


NO_ID = -(1 << 63)  #: stands for a null doc_id in a file


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all documents in ascending doc_id order; returns the index, itself a written table."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB
    name = uuid.uuid4().hex
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), text_hash()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), text_hash())

    def run(batches):
        encoder = _encoder(name, lambda: spec.value)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, n, writer, path = TaskContext.get().partitionId(), -1, None, ""
        for batch in batches:
            out = []
            for text, doc_id in zip(as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()):
                if writer is None:
                    stream, path = open_output(folder, f"part-{part:06d}")
                    writer, n = FrameWriter(stream, encoder.dtype.itemsize), n + 1
                ids = encoder.encode(text) + end
                frame, place = writer.add(NO_ID if doc_id is None else doc_id, ids)
                out.append((part, n, path, frame, place, doc_id, len(ids) // encoder.dtype.itemsize))
                if writer.bytes >= file_bytes:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(zip(*out) if out else [[]] * 7)],
                names=[f.split()[0] for f in _INDEX.split(", ")])
        if writer is not None:
            writer.close()

    return cut_lineage(map_batches(rows, run, _INDEX), "token-index")


def read_tokens(index: DataFrame, doc_ids: DataFrame | None = None, ids: bool = True) -> DataFrame:
    """part, file, frame, place, doc_id, n_tokens, ids_crc32 and (if asked for) ids of the documents
    in ``doc_ids``, or of all; frames without one of them are neither read nor decompressed."""
    at = ("part", "file", "path", "frame")
    if doc_ids is None:
        frames = index.select(*at).distinct().withColumn("places", F.lit(None).cast("array<bigint>"))
    else:
        asked = index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        frames = asked.groupBy(*at).agg(F.sort_array(F.collect_list("place")).alias("places"))
    # frames of one file stay together, so that a task reads a seek table once
    frames = frames.repartition(shuffle_partitions(index.sparkSession), "path").sortWithinPartitions("path", "frame")
    schema = "part bigint, file bigint, frame bigint, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>"

    def run(batches):
        path, stream, table = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, stream = row["path"], open_input(row["path"])
                    table = seek_table(stream, stream.size())
                known, arrays = read_frame(stream, table[row["frame"]])
                places = range(len(arrays)) if row["places"] is None else row["places"]
                out = [(row["part"], row["file"], row["frame"], p, None if known[p] == NO_ID else int(known[p]), len(arrays[p]),
                        zlib.crc32(arrays[p].astype("<u4").tobytes()), arrays[p].astype(np.int32) if ids else None) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.list_(pa.int32()) if i == 7 else pa.int64()) for i, c in enumerate(zip(*out))],
                    names=[f.split()[0] for f in schema.split(", ")])

    return map_batches(frames, run, schema)


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes all documents and reads the files back: doc_id, start (ids of all documents before
    it), n_tokens (with the end id), ids_crc32 (of the ids as little-endian 32-bit numbers).

    A null or empty text has the end id alone. A null doc_id comes first; rows that share a doc_id
    follow each other in the order of their texts' hashes. Other columns are ignored; an empty
    table writes no file.
    """
    folder = output_folder(docs.sparkSession, "tokens")
    index = write_tokens(docs, tokenizer_path, folder, end_id)
    read = read_tokens(index, ids=False)
    frames = index.groupBy("part", "file", "frame").agg(F.sum("n_tokens").alias("n"))
    # one row per file and then one per frame of a file: files are of bounded size
    files = frames.groupBy("part", "file").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("part", "file", before.alias("before"))
    inside = Window.partitionBy("part", "file").orderBy("frame", "place").rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return read.join(files, ["part", "file"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")

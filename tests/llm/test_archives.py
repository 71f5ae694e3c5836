"""WARC and token archives: exact round trips and refusal of damage."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from awkward import empty, messy, rows_of_documents  # noqa: F401
from corpuslens.llm import token_archive, warc
from corpuslens.llm.common import output_folder
from corpuslens.llm.queries import tokenizer_path

PAGES = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (7, None, "<p>same</p>"), (3, "http://c/", None),
    (4, "http://d/ü", ""), (5, "http://e/", "Grüße 😀\r\n\r\nWARC/1.1\r\n" * 10), (None, "http://f/", "<p>same</p>"), (None, "http://g/", "alone"),
    (8, "http://h/", "x" * 500_000), (9, "http://i/", "twice"), (9, "http://i/", "twice"), (9, "http://i/", "else"),
]


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id bigint, url string, html string, digest string, largest string").repartition(3)
    largest = {}
    for page_id, _, html in PAGES:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page_id is None else page_id)
    want = Counter()
    for page_id, _, html in PAGES:
        top = largest[html or ""]
        again = top >= 0 and (page_id is None or page_id < top)
        payload = (html or "").encode()
        want[page_id, len(payload), sha1_32(payload), "revisit" if again else "response", top if again else None] += 1
    assert Counter(map(tuple, warc.archive_round_trip(pages).collect())) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_payloads_and_least_bytes(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.with_revisits(pages, least_bytes=1000), output_folder(spark, "warc"), file_bytes=1)
    got = warc.read_archives(manifest).collect()
    assert all(r["record_type"] == "response" for r in got) and manifest.count() >= 1
    assert Counter((r["page_id"], bytes(r["payload"])) for r in got) == Counter((p, (h or "").encode()) for p, _, h in PAGES)


def archive(n=400):
    stream = io.BytesIO()
    stream.close = lambda: None
    writer = warc.ArchiveWriter(stream)
    for i in range(n):
        writer.add(warc.encode_record(i, f"http://x/{i}", f"<html><body>page number {i} of many pages</body></html>".encode() * 5, None))
    writer.close()
    return stream.getvalue()


def test_archive_layout():
    data = archive()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    words = zstandard.ZstdDecompressor().decompress(data[8:8 + size])
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompressobj().decompress(data[8 + size:])
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC/1.1") == 1
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 400


@pytest.mark.parametrize("spoil", [
    lambda d: d[8:], lambda d: d[:-1], lambda d: d[:-40] + bytes([d[-40] ^ 1]) + d[-39:], lambda d: b"", lambda d: d + b"junk junk junk"])
def test_damaged_archives_are_refused(spoil):
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(spoil(archive()))))


def test_damaged_records_are_refused():
    good = warc.encode_record(1, "http://x/", b"payload", None)
    assert warc.decode_record(good)["payload"] == b"payload"
    for bad in (good[:-2], good + b"x", good.replace(b"payload\r", b"pAyload\r"), good.replace(b"WARC/1.1", b"WARC/9.9"),
                good.replace(b"WARC-Date", b"WARC-Nope"), good.replace(b"response\r\n", b"whatever\r\n", 1)):
        with pytest.raises(warc.ArchiveError):
            warc.decode_record(bad)


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def test_token_round_trip(messy, empty):
    more = [(20, "<|endoftext|> <|ENDOFTEXT|>"), (21, "it's we'll İSTANBUL ΣΑΣ e\u0301 don't... a\u00a0b\x1cc 3.14 ﬁ"), (22, "\u0000\u0301 x")]
    docs = messy.select("doc_id", "text", "row").unionByName(messy.sparkSession.createDataFrame([(*m, "x") for m in more], "doc_id bigint, text string, row string"))
    rows = [(d, t) for d, t, *_ in rows_of_documents()] + more
    got = token_archive.token_round_trip(docs, tokenizer_path()).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (d, len(i := encoded(t)), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in rows)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    assert token_archive.token_round_trip(empty, tokenizer_path()).count() == 0


def test_only_asked_documents_are_read(spark, messy):
    index = token_archive.write_tokens(messy, tokenizer_path(), output_folder(spark, "tokens"), file_bytes=1)
    asked = spark.createDataFrame([(3,), (10,), (77,)], "doc_id bigint")
    got = token_archive.read_tokens(index, asked).collect()
    want = [(d, encoded(t)) for d, t, *_ in rows_of_documents() if d in (3, 10)]
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == sorted(want)


def test_frames_are_checked():
    stream = io.BytesIO()
    stream.close = lambda: None
    writer = token_archive.FrameWriter(stream, 2)
    for i in range(5):
        writer.add(i, np.arange(40_000, dtype="<u2").tobytes())
    writer.close()
    data = stream.getvalue()
    table = token_archive.seek_table(io.BytesIO(data), len(data))
    assert len(table) == 3 and table[0][0] == 0
    ids, arrays = token_archive.read_frame(io.BytesIO(data), table[1])
    assert ids.tolist() == [2, 3] and [len(a) for a in arrays] == [40_000] * 2
    with pytest.raises(ValueError):
        token_archive.read_frame(io.BytesIO(data), (*table[0][:3], table[0][3] ^ 1))
    with pytest.raises(ValueError):
        token_archive.seek_table(io.BytesIO(data[:-1]), len(data) - 1)

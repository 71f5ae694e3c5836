"""Repeated byte strings by a difference-cover suffix sort.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier. Sorting the
suffixes of the whole corpus would move every byte many times, so exact steps come first that leave
out text for which the answer is known:

1. Every window of ``LENGTH`` bytes has an anchor, the least hash of its runs of ``GRAM`` bytes.
   Windows next to each other with the same anchor form a span (about one per 36 bytes). Equal
   windows have equal anchors, so they lie in spans with the same anchor.
2. Spans are shuffled by anchor. A span whose anchor is its own repeats nothing. Of spans with the
   same bytes all but the first are covered as a whole.
3. What is left, different spans with the same anchor, is where copies begin, end or differ. Its
   text is fetched, windows whose hash occurs once are left out, and the rest is suffix-sorted by the difference cover: triples at the positions that are not
   multiples of three are sorted and named, the names are sorted by recursion, the remaining
   suffixes are merged in, and neighbours in the order are compared over ``LENGTH`` bytes. The text
   is partitioned by anchor, so that equal windows meet; the windows of an anchor with very many
   spans are dealt by their own hash instead, after a task has dropped those that it saw before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import as_bytes, cut_lineage, shuffle_partitions, map_batches, ship_with_tasks, text_hash

ship_with_tasks(__name__)

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1  #: grams of a window
CHUNK_BYTES = 24 << 20  #: text whose spans a task sorts at a time
BUFFER_BYTES = 1 << 20  #: text that is hashed at a time
BUCKETS = 8  #: buckets of spans for each partition, handled one after the other
LOCAL_SPANS = 64  #: different spans of an anchor that a task sends to the anchor's bucket
HOT_SPANS, HOT_SHARE = 10_000, 100_000  #: an anchor is hot with more spans than either total / share or so many
SORT_BYTES = 2 << 20  #: text that is suffix-sorted at a time, unless one bucket has more
COVERED, DIFFERENT = 0, 1
NO_ID = -(1 << 63)

_SPAN = np.dtype([("anchor", "<u8"), ("one", "<u8"), ("two", "<u4"), ("doc", "<i8"), ("key", "<u4"), ("start", "<u4"), ("size", "<u4"), ("own", "u1")])
_PIECE = np.dtype([("doc", "<i8"), ("key", "<u4"), ("start", "<u4"), ("end", "<u4"), ("anchor", "<u8"), ("kind", "u1")])


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def _joined(left: np.ndarray, right: np.ndarray, m: int) -> np.ndarray:
    a = left * np.uint64(m)
    a ^= a >> np.uint64(29)
    a += right
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    return a


def _grams(codes: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Hashes of all runs of ``length`` bytes, by doubling; what a power of two leaves over is joined on."""
    h, width, out, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    for m in _MULTIPLIERS:
        if length & width:
            out = h if out is None else _joined(out[:len(h) - done], h[done:], m)
            done += width
        if done == length:
            return out[:len(codes) - length + 1]
        h, width = _joined(h[:-width], h[width:], m), 2 * width
    raise ValueError(f"runs of {length} bytes are too long")


def _sliding(h: np.ndarray, best) -> np.ndarray:
    """Least (or largest) of each run of ``REACH`` values."""
    width = 1
    while 2 * width <= REACH:
        h, width = best(h[:-width], h[width:]), 2 * width
    rest = REACH - width
    return best(h[:-rest], h[rest:]) if rest else h


def spans_of(buffer: bytes, places: list[tuple[int, int]]):
    """For the documents at ``places`` (start, length) of a buffer: (number of the document, start in
    the buffer, end, anchor, repeats itself) as arrays. A span repeats itself when its anchor occurs
    in it twice within a window's reach: only then can two of its own windows be equal."""
    none = np.zeros(0, np.int64)
    if len(buffer) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    h = _grams(np.frombuffer(buffer, np.uint8))
    out = [[] for _ in range(5)]
    for k, (at, n) in enumerate(places):
        if n < LENGTH:
            continue
        own = h[at:at + n - GRAM + 1]
        least = _sliding(own, np.minimum)
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change - 1, [len(least) - 1]])
        # an anchor is a gram that is the least of some window that holds it
        padded = np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)])
        anchors = np.flatnonzero(_sliding(padded, np.maximum) == own)
        twin = np.flatnonzero((own[anchors[1:]] == own[anchors[:-1]]) & (np.diff(anchors) <= REACH))
        double = np.zeros(len(first), bool)
        if len(twin):
            low = np.searchsorted(last + REACH - 1, anchors[twin + 1])
            high = np.searchsorted(first, anchors[twin], side="right")
            for t, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
                double[a:b] |= least[first[a:b]] == own[anchors[twin[t]]]
        for o, v in zip(out, (np.full(len(first), k), first + at, last + at + LENGTH, least[first], double)):
            o.append(v)
    return tuple(np.concatenate(o) if o else e for o, e in zip(out, (none, none, none, none.astype(np.uint64), none.astype(bool))))


def _merged(pieces: np.ndarray) -> np.ndarray:
    """Covered pieces with those of a document that touch made one."""
    if not len(pieces):
        return pieces
    pieces = pieces[np.lexsort((pieces["start"], pieces["key"], pieces["doc"]))]
    new = np.ones(len(pieces), bool)
    new[1:] = (pieces["doc"][1:] != pieces["doc"][:-1]) | (pieces["key"][1:] != pieces["key"][:-1])
    # ends never fall inside a document as spans are sorted and of the same kind; a running maximum is safe
    group = np.cumsum(new)
    big = np.int64(1) << 32
    upto = np.maximum.accumulate(pieces["end"].astype(np.int64) + group * big)
    apart = new.copy()
    apart[1:] |= pieces["start"][1:].astype(np.int64) + group[1:] * big > upto[:-1]
    out = pieces[apart].copy()
    ends = np.concatenate([np.flatnonzero(apart)[1:] - 1, [len(pieces) - 1]])
    out["end"] = (upto[ends] - group[ends] * big).astype(np.uint32)
    return out


def _sorted_spans(spans: np.ndarray, local: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spans to go on with, different pieces, covered pieces) of spans that met in one place.

    In a task of documents (``local``) the first span of each kind goes on to the bucket of its
    anchor, where all meet; there, those whose anchor has several kinds are the different pieces.
    """
    spans = spans[np.argsort(spans["anchor"], kind="stable")]
    head = np.ones(len(spans), bool)
    head[1:] = spans["anchor"][1:] != spans["anchor"][:-1]
    sizes = np.diff(np.concatenate([np.flatnonzero(head), [len(spans)]]))
    alone = np.repeat(sizes == 1, sizes)
    single, several = spans[alone], spans[~alone]
    several = several[np.lexsort([several[k] for k in ("start", "key", "doc", "two", "one", "anchor")])]
    new_kind = np.ones(len(several), bool)
    for k in ("anchor", "one", "two"):
        new_kind[1:] &= several[k][1:] == several[k][:-1]
    new_kind[1:] = ~new_kind[1:]
    kinds, again = several[new_kind], several[~new_kind]
    if len(again) and not local:
        # the same span may come twice (from a task that ran twice on one document's rows)
        first = kinds[np.cumsum(new_kind)[~new_kind] - 1]
        again = again[~((again["doc"] == first["doc"]) & (again["key"] == first["key"]) & (again["start"] == first["start"]))]
    top = np.ones(len(kinds), bool)
    top[1:] = kinds["anchor"][1:] != kinds["anchor"][:-1]
    starts = np.flatnonzero(top)
    counts = np.diff(np.concatenate([starts, [len(kinds)]]))
    if local:
        place = np.arange(len(kinds)) - np.repeat(starts, counts)
        on = np.concatenate([single, kinds[place < LOCAL_SPANS]])
        different = kinds[place >= LOCAL_SPANS]
    else:
        on = spans[:0]
        different = np.concatenate([single[single["own"] > 0], kinds[np.repeat(counts > 1, counts) | (kinds["own"] > 0)]])
    return on, _as_pieces(different, DIFFERENT), _merged(_as_pieces(again, COVERED))


def _as_pieces(spans: np.ndarray, kind: int) -> np.ndarray:
    out = np.zeros(len(spans), _PIECE)
    for k in ("doc", "key", "start", "anchor"):
        out[k] = spans[k]
    out["end"], out["kind"] = spans["start"] + spans["size"], kind
    return out


def _packed(rows: np.ndarray) -> bytes:
    """Column by column and byte plane by byte plane, so that zeros stand together."""
    return b"".join(np.ascontiguousarray(rows[k]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for k in rows.dtype.names)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(data) // kind.itemsize, 0
    out = np.zeros(n, kind)
    for k in kind.names:
        width = kind[k].itemsize
        planes = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n)
        out[k] = np.ascontiguousarray(planes.T).view(kind[k]).ravel()
        at += width * n
    return out


def _slices(docs: list[tuple[int, int, bytes]]):
    """(doc, key, offset, text) of the documents in order, long ones in overlapping slices of
    ``BUFFER_BYTES`` windows. A slice cuts a span in two; both halves keep their anchor, so their
    windows still meet those of other copies."""
    for doc, key, text in sorted(set(docs), key=lambda d: d[:2]):
        for at in range(0, max(1, len(text) - LENGTH + 1), BUFFER_BYTES):
            yield doc, key, at, text[at:at + BUFFER_BYTES + LENGTH - 1]


def _spans_of_chunk(docs: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The spans of some documents (doc, key, text), in the order of documents and starts."""
    slices, out, at = list(_slices(docs)), [], 0
    while at < len(slices):
        size, end = 0, at
        while end < len(slices) and (end == at or size + len(slices[end][3]) <= BUFFER_BYTES):
            size += len(slices[end][3])
            end += 1
        part = slices[at:end]
        begins = np.concatenate([[0], np.cumsum([len(s[3]) for s in part])]).astype(np.int64)
        buffer = b"".join([s[3] for s in part])
        k, start, stop, anchor, own = spans_of(buffer, [(int(b), len(s[3])) for b, s in zip(begins, part)])
        rows = np.zeros(len(k), _SPAN)
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(buffer[a:b])[:12] for a, b in zip(start.tolist(), stop.tolist())]), [("one", "<u8"), ("two", "<u4")])
        rows["one"], rows["two"], rows["anchor"], rows["own"] = digests["one"], digests["two"], anchor, own
        rows["doc"] = np.array([s[0] for s in part], np.int64)[k]
        rows["key"] = np.array([s[1] for s in part], np.uint32)[k]
        rows["start"], rows["size"] = start - begins[k] + np.array([s[2] for s in part], np.int64)[k], stop - start
        out.append(rows)
        at = end
    return np.concatenate(out) if out else np.zeros(0, _SPAN)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (doc_id, the least number for null), key (32 bits of the text's hash), text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        text_hash().bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), F.col("text").cast("string").alias("text"))


def pieces(docs: DataFrame) -> DataFrame:
    """doc, key, kind (covered or different), start, end, anchor: the outcome of steps 1 and 2."""
    partitions = shuffle_partitions(docs.sparkSession)
    buckets = BUCKETS * partitions

    def cut(batches):
        def shipped(chunk):
            on, different, covered = _sorted_spans(_spans_of_chunk(chunk), True)
            out = []
            order = np.argsort(on["anchor"] % np.uint64(buckets), kind="stable")
            on = on[order]
            where = on["anchor"] % np.uint64(buckets)
            edges = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(on)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a < b:
                    out.append((int(where[a]), 0, _packed(on[a:b])))
            rest = np.concatenate([different, covered])
            for n, part in enumerate(np.array_split(rest, max(1, len(rest) // 4096))):
                if len(part):
                    out.append((int((int(part["doc"][0]) * 31 + n) % buckets), 1, _packed(part)))
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "kind", "block"])

        chunk, size = [], 0
        for batch in batches:
            for row in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), as_bytes(batch.column("text"))):
                chunk.append(row)
                size += len(row[2])
                if size >= CHUNK_BYTES:
                    yield shipped(chunk)
                    chunk, size = [], 0
        if chunk:
            yield shipped(chunk)

    blocks = map_batches(keyed(docs), cut, "bucket bigint, kind int, block binary")
    blocks = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    def meet(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["doc"]), pa.array(rows["key"].astype(np.int64)), pa.array(rows["kind"].astype(np.int32)),
                 pa.array(rows["start"].astype(np.int64)), pa.array(rows["end"].astype(np.int64)), pa.array(rows["anchor"].view(np.int64))],
                names=["doc", "key", "kind", "start", "end", "anchor"])

        def settled(held):
            _, different, covered = _sorted_spans(np.concatenate(held), False)
            return out(np.concatenate([different, covered]))

        held, current = [], None
        for batch in batches:
            for bucket, kind, block in zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "block")]):
                if kind:
                    yield out(_unpacked(block, _PIECE))
                    continue
                if bucket != current and held:
                    yield settled(held)
                    held = []
                current = bucket
                held.append(_unpacked(block, _SPAN))
        if held:
            yield settled(held)

    return map_batches(blocks, meet, "doc bigint, key bigint, kind int, start bigint, end bigint, anchor bigint")


def difference_cover_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of a string of positive numbers, equal only if the suffixes agree over
    ``depth`` places at least (0 follows the string).

    Suffixes at positions 1 and 2 modulo 3 are the sample: their triples are sorted and named, and
    while names repeat and cover less than the depth, the string of names is ranked by recursion.
    The others follow from their first number and the rank of the next sample suffix, and are merged
    into the sample's order.
    """
    n = len(text)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    if n < 3 or depth <= 1:
        return _named(t[:n]) if depth <= 1 else _named(t[:n] * (t.max() + 1) ** 2 + t[1:n + 1] * (t.max() + 1) + t[2:n + 2])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    base = int(t.max()) + 1
    names = _named((t[sample] * base + t[sample + 1]) * base + t[np.minimum(sample + 2, n + 2)]) if base < 1 << 21 else _named_rows(t[sample], t[sample + 1], t[np.minimum(sample + 2, n + 2)])
    if depth > 3 and names.max(initial=0) < len(sample):
        # one place of a 0 parts the two halves; names count from 1
        ranks = difference_cover_order(np.concatenate([names[:len(one)], [0], names[len(one):]]) + 1, -(-depth // 3))
        names = _named(np.concatenate([ranks[:len(one)], ranks[len(one) + 1:]]))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    zero = np.arange(0, n, 3)
    wide = int(names.max(initial=0)) + 1
    first = t[zero] * wide + rank[zero + 1]
    # merge: against positions 1 modulo 3 by (number, rank), against 2 modulo 3 by (number, number, rank)
    beside_one = t[one] * wide + rank[one + 1]
    pair = _named_rows(np.concatenate([t[zero], t[two]]), np.concatenate([t[zero + 1], t[np.minimum(two + 1, n + 2)]]), np.concatenate([rank[zero + 2], rank[np.minimum(two + 2, n + 2)]]))
    first_two, beside_two = pair[:len(zero)], pair[len(zero):]
    less_one = np.searchsorted(np.sort(beside_one), first)
    less_two = np.searchsorted(np.sort(beside_two), first_two)
    before = np.zeros(wide + 1, np.int64)  # sample suffixes below each name
    np.add.at(before, names + 1, 1)
    before = np.cumsum(before)
    order = np.sort(first)
    out = np.zeros(n, np.int64)
    out[zero] = np.searchsorted(order, first) + less_one + less_two
    # a sample suffix stands behind the smaller sample suffixes and the smaller others
    out_sample = before[names].astype(np.int64)
    in_one = np.searchsorted(order, beside_one)
    in_two = np.searchsorted(np.sort(first_two), beside_two)
    real = sample < n
    out[sample[real]] = (out_sample + np.concatenate([in_one, in_two]))[real]
    return out


def _named(keys: np.ndarray) -> np.ndarray:
    """Names from 1 on in the order of the keys."""
    order = np.argsort(keys)
    new = np.ones(len(keys), np.int64)
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.zeros(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def _named_rows(*columns: np.ndarray) -> np.ndarray:
    out = _named(columns[0])
    for c in columns[1:]:
        out = _named(out * (int(c.max(initial=0)) + 1) + c)
    return out


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes also starts earlier: in a text before
    it in the list, or in itself."""
    sizes = np.array([len(t) for t in texts])
    line = np.frombuffer(b"\0".join(texts), np.uint8)  # a window never reaches over a gap
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    windows = np.maximum(sizes - length + 1, 0)
    at = np.concatenate([np.arange(s, s + w) for s, w in zip(starts.tolist(), windows.tolist())])
    rank = difference_cover_order(line.astype(np.int64) + 1, length)[at]
    order = np.argsort(rank * (len(line) + 1) + at)
    place = at[order]
    new = np.ones(len(place), bool)
    view = np.lib.stride_tricks.sliding_window_view(line, length) if len(line) >= length else np.zeros((0, length), np.uint8)
    for a in range(1, len(place), 1 << 15):  # neighbours, compared over the whole length
        b = min(len(place), a + (1 << 15))
        new[a:b] = (view[place[a - 1:b - 1]] != view[place[a:b]]).any(axis=1)
    least = np.minimum.reduceat(place, np.flatnonzero(new)) if len(place) else place
    again = np.zeros(len(line) + 1, bool)
    again[place] = place != least[np.cumsum(new) - 1] if len(place) else False
    return [again[s:s + w] for s, w in zip(starts.tolist(), windows.tolist())]


def _twice(spans: list[tuple[int, int, int, bytes]], length: int):
    """For each span its parts with windows whose hash occurs twice here; no other window repeats."""
    line = b"\0".join([s[3] for s in spans])
    if len(line) < length:
        return
    hashes = _grams(np.frombuffer(line, np.uint8), length)
    starts = np.concatenate([[0], np.cumsum([len(s[3]) + 1 for s in spans])[:-1]])
    real = np.zeros(len(hashes), bool)
    for (_, _, _, text), a in zip(spans, starts.tolist()):
        real[a:a + max(0, len(text) - length + 1)] = True
    at = np.flatnonzero(real)
    at = at[np.argsort(hashes[at])]
    same = hashes[at[1:]] == hashes[at[:-1]]
    twice = np.zeros(len(hashes) + 1, np.int8)
    twice[at[1:][same]] = twice[at[:-1][same]] = 1
    for (doc, key, start, text), a in zip(spans, starts.tolist()):
        edge = np.flatnonzero(np.diff(twice[a:a + max(0, len(text) - length + 1)], prepend=0, append=0))
        yield [(doc, key, start + b, text[b:e - 1 + length]) for b, e in zip(edge[0::2].tolist(), edge[1::2].tolist())]


def _covered(spans: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int, int]]:
    """(doc, key, start, end) of the repeated parts of spans (doc, key, start, text)."""
    spans = [part for span in _twice(sorted(set(spans), key=lambda s: s[:3]), length) for part in span]
    out = []
    for (doc, key, start, _), again in zip(spans, repeated_windows([s[3] for s in spans], length)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
        out += [(doc, key, start + a, start + b - 1 + length) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
    return out


def different_parts(texts: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, key, start, end: the repeated parts of the different pieces (step 3)."""
    spark = texts.sparkSession
    partitions = shuffle_partitions(spark)
    buckets = BUCKETS * partitions
    wanted = found.where(F.col("kind") == DIFFERENT)
    counts = wanted.groupBy("anchor").agg(F.count("*").alias("n"))
    total = wanted.count()
    # at most HOT_SHARE anchors can have more than total / HOT_SHARE spans
    hot = spark.sparkContext.broadcast({r[0] for r in counts.where(F.col("n") > max(HOT_SPANS, total // HOT_SHARE)).select("anchor").collect()})
    asked = wanted.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "anchor"))).alias("spans"))
    rows = texts.join(asked, ["doc", "key"])
    schema = "bucket bigint, doc bigint, key bigint, start bigint, bytes binary"

    def cut(batches):
        for batch in batches:
            out, seen, dropped = [], {}, []
            docs, keys = batch.column("doc").to_pylist(), batch.column("key").to_pylist()
            for k in sorted(range(len(docs)), key=lambda k: (docs[k], keys[k])):
                doc, key, text = docs[k], keys[k], batch.column("text")[k].as_buffer().to_pybytes()
                for span in batch.column("spans")[k].as_py():
                    start, end, anchor = span["start"], span["end"], span["anchor"]
                    if anchor not in hot.value:
                        out.append((anchor % buckets, doc, key, start, text[start:end]))
                        continue
                    for at in range(start, end - length + 1):
                        window = text[at:at + length]
                        if seen.setdefault(window, (doc, key, at)) == (doc, key, at):
                            out.append((xxhash.xxh3_64_intdigest(window) % buckets, doc, key, at, window))
                        else:
                            dropped.append((-1, doc, key, at, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out + dropped], pa.binary() if i == 4 else pa.int64()) for i in range(5)], names=["bucket", "doc", "key", "start", "bytes"])

    spans = map_batches(rows, cut, schema)
    # windows that a task has seen before are settled; they are dealt anywhere
    spans = spans.withColumn("at", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("doc", "key", "start"), F.lit(buckets))))
    spans = spans.repartition(partitions, "at").sortWithinPartitions("at")

    def sort(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc", "key", "start", "end"])

        held, size, current = [], 0, None
        for batch in batches:
            settled = []
            for at, bucket, doc, key, start, text in zip(*[batch.column(c).to_pylist() for c in ("at", "bucket", "doc", "key", "start", "bytes")]):
                if bucket < 0:
                    settled.append((doc, key, start, start + length))
                    continue
                if at != current and size >= SORT_BYTES:
                    yield out(_covered(held, length))
                    held, size = [], 0
                current = at
                held.append((doc, key, start, text))
                size += len(text)
            if settled:
                yield out(settled)
        if held:
            yield out(_covered(held, length))

    return map_batches(spans, sort, "doc bigint, key bigint, start bigint, end bigint")


def kept_runs(size: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What covered ranges (in any order) leave of a text, as (start, end)."""
    out, at = [], 0
    for a, b in sorted(covered):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out + [(at, size)] if at < size else out


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (what is left, as
    bytes: a cut may fall inside a character).

    Texts are UTF-8 bytes, null is empty; texts below ``LENGTH`` bytes lose nothing. A null doc_id comes
    first. Rows that share a doc_id are different documents in the order of a hash of their texts;
    rows that repeat both are one document and share its result. Other columns are ignored; an
    empty table gives an empty result.
    """
    found = cut_lineage(pieces(docs), "pieces")
    texts = keyed(docs)
    covered = found.where(F.col("kind") == COVERED).select("doc", "key", "start", "end").unionByName(different_parts(texts, found))
    per = covered.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("covered"))
    rows = texts.join(per, ["doc", "key"], "left")

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, ranges in zip(batch.column("doc").to_pylist(), as_bytes(batch.column("text")), batch.column("covered").to_pylist()):
                runs = kept_runs(len(text), [(r["start"], r["end"]) for r in ranges or ()])
                kept = b"".join([text[a:b] for a, b in runs])
                gaps = len(runs) + 1 - (not runs or runs[0][0] == 0) - (not runs or runs[-1][1] == len(text)) if runs else int(len(text) > 0)
                out.append((None if doc == NO_ID else doc, len(text), len(text) - len(kept), gaps, hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_batches(rows, cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")

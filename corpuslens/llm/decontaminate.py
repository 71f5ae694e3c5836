"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

The windows of the items (10 words, or a whole shorter item) are the patterns. Each task builds the
automaton once and reads every text once; a text is folded byte by byte, so word numbers map back to
offsets in the original text. The items travel with the tasks, hence ``PART_BYTES``: a larger
benchmark is cut by item into parts of about that size, and the texts are read once per part.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import WORD, as_bytes, cut_lineage, folded, folded_words, map_batches, ship_with_tasks

ship_with_tasks(__name__)

WINDOW = 10
PART_BYTES = 16 << 20  #: text of the items that one automaton is built from, about
_RUNS = "array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>"
_OUT = f"row bigint, doc_id bigint, n_words bigint, runs {_RUNS}, items array<string>"


def build_automaton(items: list[tuple[str | None, bytes]], window: int = WINDOW):
    """(automaton or None, [(words of the pattern, item_ids)])."""
    import ahocorasick

    patterns: dict[bytes, set] = {}
    for item_id, text in items:
        words = folded(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            patterns.setdefault(b" ".join(words[i:i + window]), set()).add(item_id)
    found = ahocorasick.Automaton()
    facts = []
    for n, (pattern, ids) in enumerate(patterns.items()):
        found.add_word(f" {pattern.decode('latin-1')} ", n)
        facts.append((pattern.count(b" ") + 1, sorted(i for i in ids if i is not None)))
    if facts:
        found.make_automaton()
    return (found if facts else None), facts


def scan(text: bytes, found, facts) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
    """(words, runs of hit words, item ids). A run has its first and last word (exclusive) and its
    code point offsets in the original text."""
    line, starts, ends = folded_words(text)
    if not line or found is None:
        return len(starts), [], []
    runs: list[list[int]] = []
    items: set[str] = set()
    hits = sorted((int(np.searchsorted(ends, at - 1)), n) for at, n in found.iter(f" {line.decode('latin-1')} "))
    spans = sorted((last - facts[n][0] + 1, last + 1) for last, n in hits)
    for first, last in spans:
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    for _, n in hits:
        items.update(facts[n][1])
    if not runs:
        return len(starts), [], []
    # folding keeps byte positions: a word starts where a word byte follows another byte
    raw = np.frombuffer(text.translate(_MARKS), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], raw, [0]]).astype(np.int8)))
    point = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    begin, stop = edge[0::2], edge[1::2]
    return len(starts), [(a, b, int(point[begin[a]]) - 1, int(point[stop[b - 1] - 1])) for a, b in runs], sorted(items)


_MARKS = bytes(int(48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256))


def _held(key, build):
    """What this Python worker has built before for the same items."""
    store = sys.__dict__.setdefault("_built_automata", {})
    if key not in store:
        store.clear()
        store[key] = build()
    return store[key]


def _parts(benchmark: DataFrame, part_bytes: int) -> list[DataFrame]:
    """The items (item_id, text) in as many parts as their size asks for; an item_id is in one part."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    return [items] if parts == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) for p in range(parts)]


def _of_part(items: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r[0], r[1].encode()) for r in items.collect()]  # bounded by part_bytes


def _scan_part(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    shipped, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        found, facts = _held(name, lambda: build_automaton(shipped.value, window))
        for batch in batches:
            out = [scan(text, found, facts) for text in as_bytes(batch.column("text"))]
            runs = [[dict(zip(("first", "last", "start", "end"), r)) for r in x[1]] for x in out]
            run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()),
                 pa.array(runs, run_type), pa.array([x[2] for x in out], pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "runs", "items"])

    return map_batches(docs, run, _OUT)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (item_ids as sorted strings),
    runs (hit words and their code point offsets in the original text).

    Null texts and texts without words hit nothing, items without words have no window. Items that
    share an item_id count as one; an item with a null id marks words but isn't counted. Repeated
    documents are documents of their own. Other columns are ignored; empty tables work.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = _parts(benchmark, part_bytes)
    if len(parts) > 1:
        rows = cut_lineage(rows, "numbered")
    out = _scan_part(rows, _of_part(parts[0]), window)
    for part in parts[1:]:
        out = out.unionByName(_scan_part(rows, _of_part(part), window))
    if len(parts) > 1:
        out = out.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    hit = F.aggregate(
        "runs", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("bigint"), r["last"] - F.greatest(r["first"], s["upto"]))).alias("n"),
            F.greatest(s["upto"], r["last"]).alias("upto")))
    return out.select("doc_id", "n_words", hit["n"].alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "runs")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return benchmark_hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that no window of an item occurs in, with all their columns."""
    for part in _parts(benchmark, part_bytes):
        shipped, name = docs.sparkSession.sparkContext.broadcast(_of_part(part)), uuid.uuid4().hex

        def run(batches, shipped=shipped, name=name):
            found, facts = _held(name, lambda: build_automaton(shipped.value, window))
            for batch in batches:
                hit = [bool(scan(text, found, facts)[1]) for text in as_bytes(batch.column("text"))]
                yield batch.filter(pa.array([not h for h in hit], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS window FROM i, unnest(range(1, len(w) - k + 2)) AS u(s)),
s AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS window FROM d, (SELECT DISTINCT k FROM i), unnest(range(1, len(w) - k + 2)) AS u(s)),
h AS (SELECT doc_id, s, p.k, item_id FROM s JOIN p ON s.window = p.window AND s.k = p.k),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(s, s + k)) AS u(q) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id"""

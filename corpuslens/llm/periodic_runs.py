"""Periodic runs of words by longest common extensions over suffix trees.

A run is a stretch of words that repeats with a smallest period and can't be extended. Every run of
a sequence has a Lyndon root: a root starts at i and ends before the next smaller suffix of i, in
the order of the words or in the reverse one. So the candidates are the pairs (i, next smaller
suffix of i) of both orders; each is extended to the right by the longest common extension of the
two suffixes and to the left by that of the reversed prefixes. Extensions are lowest common
ancestors in Ukkonen's suffix trees of the words and of their reversal, answered in constant time
from the Euler tour of a tree and its table of minima.

Before trees are built, words that can't belong to a run are set aside by an exact condition: in a
run of period q with four periods or more, each four words behind the first period occurred q or
fewer words before. Stretches that meet it are widened so far that whole runs and the words beside
them lie inside; all runs are found by the method above.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import as_bytes, map_batches, ship_with_tasks

ship_with_tasks(__name__)

LEAST_LENGTH = 6  #: words of a run
LEAST_PERIODS = 4  #: length of a run in periods
WINDOW = 4  #: words whose earlier occurrence decides where a run may lie
_FAR = np.iinfo(np.int64).max
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


# ---- suffix trees -------------------------------------------------------------------
class SuffixTree:
    """Ukkonen's tree of a sequence of positive numbers; number 0 is the end mark behind it."""

    def __init__(self, sequence: list[int]):
        text = [*sequence, 0]
        n = len(text)
        start, end, link, kids, suffix, depth = [0], [0], [0], [{}], [-1], [0]
        node = edge = length = open_ends = 0
        for i, symbol in enumerate(text):
            open_ends += 1
            waiting = 0  # an inner node that still needs its suffix link
            while open_ends:
                if not length:
                    edge = i
                child = kids[node].get(text[edge])
                if child is None:
                    kids[node][text[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), kids.append(None), suffix.append(i - open_ends + 1), depth.append(0)
                    if waiting:
                        link[waiting] = node
                    waiting = node
                else:
                    begin = start[child]
                    long = end[child] - begin
                    if length >= long:
                        node, edge, length = child, edge + long, length - long
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    inner = len(start)
                    kids[node][text[edge]] = inner
                    start.append(begin), end.append(begin + length), link.append(0), suffix.append(-1), depth.append(open_ends - 1)
                    kids.append({symbol: inner + 1, text[begin + length]: child})
                    start[child] = begin + length
                    start.append(i), end.append(n), link.append(0), kids.append(None), suffix.append(i - open_ends + 1), depth.append(0)
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                open_ends -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - open_ends + 1
        self.size, self.depth, self.kids, self.suffix = n, depth, kids, suffix

    def tour(self, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        """(depths, place of each suffix among them, rank of each suffix, rank where the end mark is the largest).

        The depths are those at which an Euler tour comes back to an inner node between two of its
        children, so that the least depth from the place of one suffix up to that of a later one is the
        depth of their lowest common ancestor. Ranks mean something on an ordered tour only.
        """
        kids, suffix, depth = self.kids, self.suffix, self.depth
        place, first, last = [0] * self.size, [0] * self.size, [0] * self.size
        depths, stack, n_first, n_last = [], [0], 0, 0
        while stack:
            x = stack.pop()
            if x < 0:  # between two children
                depths.append(~x)
                continue
            if type(x) is float:  # all children of a node are done: a suffix that ends at it
                last[int(x)] = n_last
                n_last += 1
                continue
            below = kids[x]
            if below is None:
                place[s := suffix[x]] = len(depths)
                first[s] = n_first
                last[s] = n_last
                n_first += 1
                n_last += 1
                continue
            back = ~depth[x]
            if ordered:
                symbols = sorted(below, reverse=True)
                if not symbols[-1]:  # the end mark: first by one rank, last by the other
                    place[s := suffix[below[symbols.pop()]]] = len(depths)
                    first[s] = n_first
                    n_first += 1
                    if symbols:
                        depths.append(~back)
                    stack.append(float(s))
                for symbol in symbols:
                    stack.append(below[symbol])
                    stack.append(back)
            else:
                for child in below.values():
                    stack.append(child)
                    stack.append(back)
            if below and stack[-1] == back:
                stack.pop()
        return np.array(depths, np.int32), np.array(place, np.int64), first, last


def extensions(depths: np.ndarray, place: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the longest common extensions of suffixes a and b (different ones), in
    constant time each: minima of the depths over stretches of powers of two."""
    table = np.zeros((max(1, len(depths)).bit_length(), len(depths)), np.int32)
    table[0] = depths
    for k in range(1, len(table)):
        step = 1 << (k - 1)
        np.minimum(table[k - 1, :-step], table[k - 1, step:], out=table[k, :-step])

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(place[a], place[b]), np.maximum(place[a], place[b])
        k = np.frexp((high - low).astype(np.float64))[1].astype(np.int64) - 1
        return np.minimum(table[k, low], table[k, high - (1 << k)]).astype(np.int64)

    return extension


def next_smaller(rank: list[int]) -> list[int]:
    """For each suffix but the end mark, the next one with a smaller rank."""
    out, stack = [0] * (len(rank) - 1), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of_sequence(sequence: list[int], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of positive numbers, by start, then period."""
    n = len(sequence)
    depths, place, first, last = SuffixTree(sequence).tour(ordered=True)
    # in the reverse order of the words a suffix still comes before those that it begins: the reverse
    # of the rank in which the end mark is the largest
    ends = np.array([next_smaller(first), next_smaller([-r for r in last])], np.int64)
    i, j = np.tile(np.arange(n), 2), ends.ravel()
    short = (j - i) * least_periods <= n
    short[n:] &= ends[0] != ends[1]
    i, j = i[short], j[short]
    if not len(i):
        return np.zeros((0, 3), np.int64)
    right = extensions(depths, place)(i, j)
    left = extensions(*SuffixTree(sequence[::-1]).tour()[:2])(n - i, n - j)
    start, length, period = i - left, left + (j - i) + right, j - i
    long = length >= np.maximum(least_length, least_periods * period)
    found = np.stack([start[long], period[long], length[long]], axis=1)
    return np.unique(found, axis=0)[:, [0, 2, 1]]


# ---- whole texts --------------------------------------------------------------------
def _stretches(holds: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [from, to) of ``least`` or more true elements."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], holds.view(np.int8), [0]])))
    long = edges[1::2] - edges[::2] >= least
    return list(zip(edges[::2][long].tolist(), edges[1::2][long].tolist()))


def regions(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [from, to) that hold all runs of ``LEAST_LENGTH`` words and ``LEAST_PERIODS``
    periods, and the words beside each run.

    A run of period q has at least max(2, 3q - 3) windows of four words behind its first period, one
    after the other, each of which occurred q or fewer words before. Periods are taken by powers of
    two first, then in steps of an eighth. Where all windows of a stretch lie the same number of words
    behind their last occurrence, all its words repeat with that period, and by the theorem of Fine
    and Wilf no run of another smallest period has four periods there. Equal hashes of different
    windows only add stretches.
    """
    n = len(numbers) - WINDOW + 1
    if n < 3:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = (key ^ numbers[k:n + k].astype(np.uint64)) * _MIX[0]
        key = (key ^ (key >> _MIX[2])) * _MIX[1]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(np.diff(key[order]) == 0)
    if not len(same):
        return []
    back = np.full(n, _FAR)
    back[order[same + 1]] = order[same + 1] - order[same]
    found, least = [], 1
    while (need := max(2, 3 * least - 3)) <= len(same):
        most = least * 2 - 1  # periods from least to most
        for low, high in _stretches(back <= most, need):
            steady = int(back[low])
            if (back[low:high] == steady).all():  # only a run of this very period
                if least <= steady and high - low >= max(2, 3 * steady - 3):
                    found.append((low - steady - 1, high))
                continue
            shortest = least
            while shortest <= most:  # the same in smaller steps, inside the stretch
                longest = min(most, shortest + shortest // 8)
                for a, b in _stretches(back[low:high] <= longest, max(2, 3 * shortest - 3)):
                    found.append((low + a - longest - 1, low + b))
                shortest = longest + 1
        least *= 2
    found = [(max(0, low), min(len(numbers), high + WINDOW)) for low, high in found]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


class _Numbers(dict):
    """Numbers its keys from 1 in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self) + 1
        return n


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text, by start, then period."""
    numbers = _Numbers()
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    out = []
    for low, high in regions(at):
        found = runs_of_sequence(at[low:high].tolist())
        found[:, 0] += low
        out += map(tuple, found.tolist())
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run behind its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rewriting of the registered query: every tenth document by checksum of its number goes on
    periodically from some word on. A null doc_id changes nothing."""
    h, n = (1, 0) if doc_id is None else (zlib.crc32(str(doc_id).encode()), len(words))
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period),
    collapsed (the words that no run repeats, joined by one space).

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, numbered from 0. A null, empty or wordless
    text has no words and no runs and collapses to the empty text. Repeated rows and null doc_ids are rows of
    their own; other columns are ignored; an empty table gives an empty result. Texts are handled
    one after the other and whole: the trees of the longest stretch that may hold runs are what a
    task needs at once. ``rewrite`` changes the words of a document first.
    """
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            sizes, found, kept = [], [], []
            for doc_id, text in zip(ids, as_bytes(batch.column("text"))):
                words = text.split()
                if rewrite:
                    words = rewrite(doc_id, words)
                runs = runs_of_words(words)
                sizes.append(len(words)), found.append(runs), kept.append(b" ".join(collapsed(words, runs)).decode())
            item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            runs = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(item)), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without runs) with
    its exponent_milli, runs_sha256, collapsed_sha256, n_words."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))")
    line = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.withColumn("top", longest)
    length = -F.col("top.l")
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.s").alias("start"), length.alias("length"), F.col("top.p").alias("period"),
        F.floor(length * 1000 / F.col("top.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")

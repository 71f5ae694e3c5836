"""Near-duplicate join on word shingles: MinHash, Bayesian pruning, exact verification.

Documents with the same shingle set are one class. Classes that share a band of their signatures
are candidates; a pair is looked at in the first band that it shares only. Its MinHash values are
compared a few at a time, and it is dropped as soon as the posterior probability of reaching the
threshold falls below a tolerance. What is left is verified on the shingle sets themselves.

Pairs are arrays inside a task and never rows. A band with many members is cut into blocks, and
each pair of blocks is a group of its own, so no group outgrows a task; the work for a large group
of texts that are all different still grows with its pairs, which is what asking for all links means.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import as_bytes, cut_lineage, folded_words, shuffle_partitions, map_batches, ship_with_tasks, text_hash, unused_names
from corpuslens.llm.components import components

ship_with_tasks(__name__)

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BAND = 4  #: values per band; 32 bands miss a pair at the threshold with probability 5e-8
STEP = 16  #: values compared between two looks at the posterior
TOLERANCE = 1e-6
BLOCK = 2000  #: members of one band that meet in one group
PAIRS = 1 << 17  #: pairs looked at together

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(2024)
_A = (_rng.integers(1 << 32, size=HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)
del _rng


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` words; a shorter text is one run, a text
    without words has none. Runs are hashed by one prefix sum over the folded text."""
    line, starts, ends = folded_words(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    first, last = (starts[:-size + 1], ends[size - 1:]) if len(starts) >= size else (starts[:1], ends[-1:])
    n = len(line)
    power, back = np.full(n, _BASE), np.full(n, _INVERSE)
    power[0] = back[0] = 1
    codes = np.frombuffer(line, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(power))])
    runs = (sums[last] - sums[first]) * np.cumprod(back)[first] + (last - first).astype(np.uint64)
    return np.unique(_mixed(runs))


def signature(runs: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values, 16 bits of each."""
    x = (runs >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[at:at + 2048, None] * _A + _B).min(axis=0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """How many of the first m values must agree (m in steps): with fewer, the posterior probability
    under a uniform prior that the similarity is at least the threshold is below the tolerance."""
    x = (np.arange(20000) + 0.5) / 20000
    out = {}
    for m in range(STEP, HASHES + 1, STEP):
        for k in range(m + 1):
            log = k * np.log(x) + (m - k) * np.log1p(-x)
            mass = np.exp(log - log.max())
            if mass[x >= threshold].sum() >= tolerance * mass.sum():
                out[m] = k
                break
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key (digest of the shingle set, null without words), sig."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_key"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            keys, sigs = [], []
            for text in as_bytes(batch.column("text")):
                runs = shingles(text)
                keys.append(hashlib.blake2b(runs.tobytes(), digest_size=16).digest() if len(runs) else None)
                sigs.append(signature(runs).tobytes() if len(runs) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_key", "set_key", "sig"])

    return map_batches(rows, run, "doc_id bigint, text_key bigint, set_key binary, sig binary")


def grouped(batches, columns: tuple[str, ...]):
    """(lists of the columns) per run of equal values of the column ``gid``, across batches."""
    held: list[list] = [[] for _ in columns]
    current = None
    for batch in batches:
        gids = batch.column("gid").to_numpy(zero_copy_only=False)
        data = [batch.column(c).to_pylist() for c in columns]
        cuts = [0, *(np.flatnonzero(gids[1:] != gids[:-1]) + 1).tolist(), len(gids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if current is not None and gids[a] != current:
                yield current, held
                held = [[] for _ in columns]
            current = int(gids[a])
            for h, d in zip(held, data):
                h.extend(d[a:b])
    if current is not None:
        yield current, held


def surviving(sigs: np.ndarray, one: np.ndarray, two: np.ndarray, band: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which of the pairs (one, two) meet here for the first time and are not dropped on the way."""
    bands = sigs.view("<u8")
    alive = np.flatnonzero((bands[one] == bands[two]).argmax(axis=1) == band)
    matches = np.zeros(len(alive), np.int64)
    for m, least in need.items():
        matches += (sigs[one[alive], m - STEP:m] == sigs[two[alive], m - STEP:m]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def group_pairs(blocks: np.ndarray):
    """Pairs of members (in pieces): all of them in a group of one block, else those across."""
    if blocks.min() == blocks.max():
        n = len(blocks)
        if n <= 400:
            yield np.triu_indices(n, 1)
        else:
            rows = max(1, PAIRS // n)
            for a in range(0, n, rows):
                i, j = np.meshgrid(np.arange(a, min(n, a + rows)), np.arange(n), indexing="ij")
                yield i[i < j], j[i < j]
        return
    left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks != blocks.min())
    rows = max(1, PAIRS // len(right))
    for a in range(0, len(left), rows):
        i, j = np.meshgrid(left[a:a + rows], right, indexing="ij")
        yield i.ravel(), j.ravel()


def candidates(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """gid, set_key, partners: the pairs that survive, by the group in which they met. ``partners``
    are the keys of a class's partners, one behind the other; every member of a pair has a row."""
    spark = classes.sparkSession
    bands = classes.select("set_key", F.explode(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1))).alias("band"), "sig")
    bands = bands.select("set_key", "band", F.xxhash64("band", F.expr(f"substring(sig, {2 * BAND} * band + 1, {2 * BAND})")).alias("bucket"))
    counts = cut_lineage(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = bands.join(counts, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("set_key", "bucket"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "set_key", "band", "block", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("gid"))
    rows = members.join(classes.select("set_key", "sig"), "set_key")
    rows = rows.repartition(shuffle_partitions(spark), "gid").sortWithinPartitions("gid")
    need = least_matches(threshold, tolerance)

    def run(batches):
        def looked_at(held):
            """Output rows for some groups: (gid, key, partner keys)."""
            keys = [k for h in held for k in h[1]]
            sigs = np.frombuffer(b"".join(s for h in held for s in h[2]), "<u2").reshape(len(keys), HASHES)
            bands = np.array([b for h in held for b in h[3]])
            pieces, at = [], 0
            ones, twos = [], []
            size = 0

            def look():
                one, two = np.concatenate(ones), np.concatenate(twos)
                for a in range(0, len(one), PAIRS):
                    i, j = one[a:a + PAIRS], two[a:a + PAIRS]
                    alive = surviving(sigs, i, j, bands[i], need)
                    pieces.append((i[alive], j[alive]))

            for h in held:
                for i, j in group_pairs(np.array(h[4])):
                    ones.append(i + at)
                    twos.append(j + at)
                    size += len(i)
                    if size >= PAIRS:
                        look()
                        ones, twos, size = [], [], 0
                at += len(h[1])
            if ones:
                look()
            one = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, int)
            two = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros(0, int)
            gids = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            order = np.argsort(one, kind="stable")
            one, two = one[order], two[order]
            out = []
            for k in np.union1d(one, two).tolist():
                a, b = np.searchsorted(one, [k, k + 1])
                out.append((int(gids[k]), keys[k], b"".join([keys[t] for t in two[a:b].tolist()])))
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["gid", "set_key", "partners"])

        held, size = [], 0
        for gid, (keys, sigs, bands, blocks) in grouped(batches, ("set_key", "sig", "band", "block")):
            held.append((gid, keys, sigs, bands, blocks))
            size += len(keys)
            if size >= 4000:
                yield looked_at(held)
                held, size = [], 0
        if held:
            yield looked_at(held)

    return map_batches(rows, run, "gid bigint, set_key binary, partners binary")


def verified(sets: dict[bytes, np.ndarray], partners: dict[bytes, list[bytes]], threshold: float) -> list[tuple[bytes, bytes]]:
    """The pairs whose shingle sets reach the threshold."""
    names = list(sets)
    place = {k: i for i, k in enumerate(names)}
    sizes = np.array([len(sets[k]) for k in names])
    words, ids = np.unique(np.concatenate([sets[k] for k in names]), return_inverse=True)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(words), bool)
    out = []
    for key, others in partners.items():
        at = np.array([place[o] for o in others if o in place], int)
        if not len(at):
            continue
        own = parts[place[key]]
        mark[own] = True
        for a in range(0, len(at), 256):
            some = at[a:a + 256]
            shared = np.add.reduceat(mark[np.concatenate([parts[i] for i in some])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            good = shared >= threshold * (len(own) + sizes[some] - shared) - 1e-9
            out += [(key, names[i]) for i in some[good].tolist()]
        mark[own] = False
    return out


def links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """set_key, n_links, root: per group in which pairs were verified, a class's number of links and
    the least class that they connect it with."""
    found = cut_lineage(candidates(classes, threshold), "candidates")
    wanted = found.join(classes.select("set_key", "rep"), "set_key").select(
        "gid", "set_key", "partners", F.col("rep.doc_id").alias("w_id"), F.col("rep.text_key").alias("w_key"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))).select("gid", "set_key", "partners", "text")

    def cut(batches):
        last, packed = None, b""
        for batch in batches:
            sets = []
            for key, text in zip(batch.column("set_key").to_pylist(), as_bytes(batch.column("text"))):
                if key != last:
                    last, packed = key, shingles(text).tobytes()
                sets.append(packed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("gid"), batch.column("set_key"), batch.column("partners"), pa.array(sets, pa.binary())],
                names=["gid", "set_key", "partners", "runs"])

    sets = map_batches(rows, cut, "gid bigint, set_key binary, partners binary, runs binary")
    sets = sets.repartition(shuffle_partitions(docs.sparkSession), "gid").sortWithinPartitions("gid")

    def check(batches):
        for _, (keys, partners, runs) in grouped(batches, ("set_key", "partners", "runs")):
            known = {k: np.frombuffer(r, np.uint64) for k, r in zip(keys, runs)}
            asked = {k: [p[i:i + 16] for i in range(0, len(p), 16)] for k, p in zip(keys, partners) if p}
            pairs = verified(known, asked, threshold) if len(known) > 1 else []
            root, degree = {}, {}

            def top(k):
                while root.setdefault(k, k) != k:
                    root[k] = k = root[root[k]]
                return k

            for a, b in pairs:
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                a, b = sorted((top(a), top(b)))
                root[b] = a
            if degree:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(degree), pa.binary()), pa.array(list(degree.values()), pa.int64()), pa.array([top(k) for k in degree], pa.binary())],
                    names=["set_key", "n_links", "root"])

    return map_batches(sets, check, "set_key binary, n_links bigint, root binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, copy_id, n_links, stays.

    Words are those of ``common.WORD`` in small letters, shingles five of them (a shorter text is one
    shingle). class_id is the smallest doc_id of the documents that links connect, copy_id that of the
    documents with the very same shingles, n_links the number of different shingle sets with a
    similarity of at least the threshold. A null or wordless text is alone: class_id and copy_id
    are its doc_id. One document of a class stays, the one with the smallest (non-null) doc_id; of
    rows that repeat it, ``kept_documents`` keeps one. Other columns are ignored; empty tables work.
    """
    rows = cut_lineage(signatures(docs), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = cut_lineage(
        rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(order).alias("rep"), F.first("sig").alias("sig")), "classes")
    linked = cut_lineage(links(docs, classes, threshold), "links")
    degrees = linked.groupBy("set_key").agg(F.sum("n_links").alias("n_links"))
    roots = components(linked.select(F.col("set_key").alias("u"), F.col("root").alias("v")))
    reps = classes.select("set_key", "rep")
    firsts = roots.join(reps, roots["node"] == reps["set_key"]).groupBy("root").agg(F.min("rep").alias("first"))
    tops = roots.join(firsts, "root").select(F.col("node").alias("set_key"), "first")
    named = cut_lineage(reps.join(tops, "set_key", "left").join(degrees, "set_key", "left"), "named")
    out = rows.drop("sig").join(named, "set_key", "left")
    first = F.coalesce("first", "rep", order)
    return out.select(
        "doc_id", "text_key", first["doc_id"].alias("class_id"), F.coalesce("rep", order)["doc_id"].alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("text_key") == first["text_key"])).alias("stays"))


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; repeated rows once."""
    key, stay_id, stay_key = unused_names(docs, "_near_key", "_stay_id", "_stay_key")
    stay = near_duplicates(docs, threshold).where("stays").select(F.col("doc_id").alias(stay_id), F.col("text_key").alias(stay_key)).distinct()
    keyed = docs.withColumn(key, text_hash())
    on = F.col("doc_id").cast("bigint").eqNullSafe(F.col(stay_id)) & (F.col(key) == F.col(stay_key))
    return keyed.join(stay, on, "left_semi").dropDuplicates(["doc_id", key]).drop(key)

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows that may be learned from. The weights are trained by
follow-the-regularised-leader (per-coordinate rates, elastic net: the first penalty makes weights
exactly zero) on a bounded sample per language, and a temperature is fitted on a part of the sample
that the weights have not seen. Prediction reads whole texts inside the tasks. The n-grams are of
characters: code points in small letters, where whatever is no letter is a gap.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.common import as_bytes, cut_lineage, map_batches, ship_with_tasks

ship_with_tasks(__name__)

BUCKETS = 1 << 16  #: hashed n-grams
ORDERS = (1, 2, 3)  #: lengths of the n-grams, in characters
SAMPLE_SLOTS, SAMPLE_PER_SLOT = 200, 3  #: weights and temperature are fitted on that many labelled rows per language at most
SMOOTHING = 0.02  #: share of doubt in the labels that the temperature is fitted on
CALIBRATION = 5  #: every fifth slot of the sample fits the temperature
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.5, 1.0
LEAST_SCORE = 0.3  #: documents below it count as of unknown language when a corpus is filtered
UNKNOWN = "und"
CHUNK = 1 << 16  #: characters of a text handled at a time
BROADCAST_ROWS = 1_000_000  #: keys of a sample that are broadcast; more are joined by a shuffle
_STEP = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_GAP = 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point itself if it is a letter or a mark on one, else a gap; made once per worker."""
    if not _LETTERS:
        table = np.full(sys.maxunicode + 1, _GAP, np.uint32)
        at = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M"]
        table[at] = at
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a whole text, a piece of ``CHUNK`` characters at a time."""
    folded = np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    total = None
    for at in range(0, max(1, len(folded)), CHUNK):
        codes = letters()[folded[at:at + CHUNK + max(ORDERS) - 1]]
        gram, found = np.zeros(len(codes), np.uint32), []
        for n in ORDERS:
            # grams start inside this piece; the characters after it only complete them
            gram = gram[:len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1:]
            found.append(((gram[:CHUNK] + np.uint32(n)) * _STEP[n - 1]) >> shift)
        counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
        total = counts if total is None else total + counts
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(counted: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the TF-IDF vector of length 1; counts enter by their logarithm."""
    at, counts = counted
    values = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, values / norm if norm else values


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> np.ndarray:
    """Weights (buckets x languages) by follow-the-regularised-leader, one row at a time."""
    z, n = np.zeros((BUCKETS, languages)), np.zeros((BUCKETS, languages))  # 1 MB a language

    def weights(at):
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, values, label = rows[k]
            w = weights(at)
            error = softmax(values @ w)
            error[label] -= 1
            g = values[:, None] * error[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section on its logarithm. The
    labels are smoothed a little: rows that are all told right would else ask for no doubt at all."""
    aim = np.full(scores.shape, SMOOTHING / scores.shape[1])
    aim[np.arange(len(labels)), labels] += 1 - SMOOTHING

    def loss(t):
        return -(aim * np.log(np.maximum(softmax(scores / np.exp(t)), 1e-12))).sum(axis=1).mean()

    low, high, ratio = -5.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents per bucket, documents), over all rows: one partial count per batch of texts."""
    def run(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                total[gram_counts(text)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at.tolist(), BUCKETS], pa.int32()), pa.array([*total[at].tolist(), n], pa.int64())], names=["bucket", "n"])

    sums = map_batches(docs.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in sums:  # at most BUCKETS + 1 rows
        out[bucket] = n
    return out[:BUCKETS], int(out[BUCKETS])


def sampled(docs: DataFrame, slots: int, per_slot: int) -> DataFrame:
    """text, lang, at: of every language the first ``per_slot`` rows of each of ``slots`` slots by hash of
    the text (hence the same on every run, and no language is ranked by one task). Only keys are
    shuffled to choose them."""
    keys = docs.select("lang", F.xxhash64("text").alias("key"))
    rank = F.row_number().over(Window.partitionBy("lang", "at").orderBy("key"))
    firsts = keys.withColumn("at", F.pmod("key", F.lit(slots)).cast("int")).distinct().withColumn("rank", rank).where(F.col("rank") <= per_slot)
    chosen = cut_lineage(firsts.drop("rank"), "sample")  # slots * per_slot rows a language at most
    small = chosen.count() <= BROADCAST_ROWS
    picked = docs.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen) if small else chosen, ["lang", "key"])
    return picked.dropDuplicates(["lang", "key"]).select("text", "lang", "at")


class Model:
    """Languages, weights, idf and temperature; a few hundred kB."""

    def __init__(self, languages, weights, idf, divisor):
        self.languages, self.weights, self.idf, self.divisor = languages, weights, idf, divisor

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text.decode()):
            return UNKNOWN, 0.0
        at, values = features(gram_counts(text), self.idf)
        p = softmax(values @ self.weights[at] / self.divisor)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(docs: DataFrame, slots: int = SAMPLE_SLOTS, per_slot: int = SAMPLE_PER_SLOT) -> Model:
    """A model from documents (text, lang) of all their languages; rows without text or lang are left out."""
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    seen, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + seen)) + 1

    def run(batches):
        for batch in batches:
            found = [features(gram_counts(t), idf) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").cast(pa.string()), batch.column("at"), pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["lang", "at", "buckets", "weights"])

    # slots * per_slot sparse vectors a language at most, 6 bytes for each n-gram of a text
    sample = map_batches(sampled(docs, slots, per_slot), run, "lang string, at int, buckets binary, weights binary").collect()
    sample = sorted((r for r in sample if r["buckets"]), key=lambda r: (r["at"], r["lang"], r["buckets"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), idf, 1.0)
    rows = [(np.frombuffer(r["buckets"], "<u2").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(np.float64), languages.index(r["lang"])) for r in sample]
    late = [r for r, s in zip(rows, sample) if s["at"] % CALIBRATION == 0]
    weights = train([r for r, s in zip(rows, sample) if s["at"] % CALIBRATION], len(languages))
    divisor = temperature(np.array([v @ weights[a] for a, v, _ in late]), np.array([k for *_, k in late])) if late else 1.0
    return Model(languages, weights.astype(np.float32), idf, divisor)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null doc_id has the empty text as its number."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 3 == 1


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.idf, model.divisor))

    def run(batches):
        known = Model(*shipped.value)
        for batch in batches:
            out = [known.predict(t) for t in as_bytes(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return map_batches(rows, run, f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents with a known language, with all their columns: neither ``und`` (null texts and those
    without a letter) nor below the score. Repeated rows are judged alike; an empty table gives none."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.idf, model.divisor))

    def run(batches):
        known = Model(*shipped.value)
        for batch in batches:
            found = [known.predict(t) for t in as_bytes(batch.column("text"))]
            yield batch.filter(pa.array([name != UNKNOWN and score >= least_score for name, score in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def language_of_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from the rows with text and lang that are not held out, predicts all. A null text, one
    without letters, or any text where nothing could be learned is ``und`` with score 0. Repeated
    rows are predicted alike. Other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model, ("doc_id", "held_out"))

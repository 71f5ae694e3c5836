"""Quality rules as a bitmask ledger.

Every text is measured once. Each rule is a condition over the measurements and owns one bit; the
ledger holds a document's measurements and the bits of the rules it fails. A policy is a named,
versioned set of rules, that is a mask: it is applied, changed and compared over the ledger alone,
and what each rule of a policy does is counted over the distinct bit patterns with bitwise
aggregates. No text is read again for any of it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import as_bytes, map_batches, ship_with_tasks
from corpuslens.session import local_rows

ship_with_tasks(__name__)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_capitals", "n_letter_words", "n_repeat_words")

#: (name, condition of failure over the measurements); the position is the bit. New rules go to the
#: end, and a rule that changes gets a new name, so that stored ledgers keep their meaning.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("bullet_lines", "100 * n_bullet_lines > 90 * n_lines"),
    ("ellipsis_lines", "100 * n_ellipsis_lines > 30 * n_lines"),
    ("few_letter_words", "100 * n_letter_words < 80 * n_words"),
    ("capitals", "100 * n_capitals > 30 * word_chars"),
)

#: (policy, version, its rules)
POLICIES = (
    ("base", 1, ("few_words", "repeated_windows")),
    ("production", 1, ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "duplicate_lines")),
    ("production", 2, tuple(name for name, _ in RULES)),
)
PRODUCTION = ("production", 2)

_SPACES = b"\t\n\x0b\x0c\r "
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in _SPACES)
_NO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_NO_WORD_CHARS = _SPACES + bytes(range(0x80, 0xC0))  # spaces, and all but the first byte of a character
_SYMBOLS = b"#*$%&|<>"
_BULLETS = (b"-", b"*", "•".encode())
_ELLIPSES = (b"...", "…".encode())


class _Numbers(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    numbers = _Numbers()
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pair = at[:-1] * len(numbers) + at[1:]
    if len(numbers) >= 1 << 21:  # three numbers wouldn't fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(numbers) + at[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    often = np.zeros(len(window), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(window) + shift] |= often
    return int(covered.sum())


def measured(text: bytes) -> tuple[int, ...]:
    """The ``MEASURES`` of one text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), len(text.translate(None, _NO_WORD_CHARS)), len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), sum(line.lstrip().startswith(_BULLETS) for line in lines),
        sum(line.rstrip().endswith(_ELLIPSES) for line in lines), len(text.translate(None, _NO_CAPITALS)),
        len(text.translate(None, _NO_LETTERS).split()), repeated_words(words),
    )


def failure_bits(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The bits of the failed rules from the measurements."""
    bits = F.lit(0).cast("bigint")
    for k, (_, condition) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def mask_of(wanted: Sequence[str], rules: Sequence[tuple[str, str]] = RULES) -> int:
    names = [name for name, _ in rules]
    return sum(1 << names.index(name) for name in wanted)


def ledger(docs: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per document: doc_id, the ``MEASURES`` (bigint), failed (bits of the failed rules).

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, lines are split at ``\\n`` and count if
    they hold a word. A null text is the empty text: all measurements are 0, and only rules that
    fail at 0 fail. Repeated rows and null doc_ids are rows of their own; other columns are
    ignored; an empty table gives an empty ledger. A text is measured whole, whatever its length.
    """
    def run(batches):
        for batch in batches:
            found = [measured(text) for text in as_bytes(batch.column("text"))]
            columns = zip(*found) if found else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{m} bigint" for m in ("doc_id", *MEASURES))
    return map_batches(rows, run, schema).withColumn("failed", failure_bits(rules))


def passes(failed: Column, policy: str, version: int, policies=POLICIES, rules=RULES) -> Column:
    """Whether bits of failed rules pass a policy."""
    wanted = {(p, v): r for p, v, r in policies}[policy, version]
    return failed.bitwiseAND(F.lit(mask_of(wanted, rules)).cast("bigint")) == 0


def ablations(entries: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """What each rule does in each policy, from a ledger: policy, version, rule, n_docs, n_kept (by
    the policy), n_failed (the rule), n_only (kept if the policy were without the rule), also (bits
    of the policy's other rules that fail beside it at least once), always (... every time).

    The ledger is summed to one row per pattern of bits, 2 to the number of rules at most, before it
    meets the policies. An empty ledger gives rows of zeros.
    """
    fields = "policy string, version int, rule string, mask bigint, bit bigint"
    steps = [(p, v, name, mask_of(wanted, rules), mask_of([name], rules)) for p, v, wanted in policies for name in wanted]
    asked = local_rows(entries.sparkSession, steps, fields)
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    # as many elements as there are rules in policies: fixed by the parameters
    every = F.array(*[F.struct(*[F.lit(x) for x in step]) for step in steps])
    tested = patterns.withColumn("step", F.explode(every.cast(f"array<struct<{fields.replace(' ', ':').replace(',:', ', ')}>>"))).select("failed", "n", "step.*")
    here = F.col("failed").bitwiseAND(F.col("mask"))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    others = here.bitwiseXOR(F.col("bit"))
    counted = tested.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(here == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(here == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or(F.when(hit, others)).alias("also"), F.bit_and(F.when(hit, others)).alias("always"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "n_kept", "n_failed", "n_only", "also", "always")]
    return asked.select("policy", "version", "rule").join(counted, ["policy", "version", "rule"], "left").select("policy", "version", "rule", *zero)


def quality_verdicts(docs: DataFrame, policy: tuple[str, int] = PRODUCTION) -> DataFrame:
    """The ledger with base_failed (a rule of the base policy fails) and kept (neither base nor ``policy`` fails)."""
    entries = ledger(docs)
    base = passes(F.col("failed"), "base", 1)
    return entries.select("*", (~base).alias("base_failed"), (base & passes(F.col("failed"), *policy)).alias("kept"))


def _ledger_sql() -> str:
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
    return rf"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT rid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT *, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM e WINDOW p AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w1, w2, w3) > 1 AS often FROM t),
r AS (SELECT rid, i, often OR coalesce(lag(often) OVER p, false) OR coalesce(lag(often, 2) OVER p, false) AS covered FROM c WINDOW p AS (PARTITION BY rid ORDER BY i)),
n AS (SELECT rid, count(CASE WHEN covered THEN 1 END) AS n FROM r GROUP BY rid),
m AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
 CAST(len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
 CAST(len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
 CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
 CAST(len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS BIGINT) AS n_letter_words, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN n USING (rid)),
l AS (SELECT doc_id, {', '.join(MEASURES)}, CAST({bits} AS BIGINT) AS failed FROM m)"""


def _mask(policy: str, version: int) -> int:
    return mask_of({(p, v): r for p, v, r in POLICIES}[policy, version])


ORACLE = f"""WITH {_ledger_sql()}
SELECT *, failed & {_mask('base', 1)} <> 0 AS base_failed, failed & {_mask('base', 1) | _mask(*PRODUCTION)} = 0 AS kept FROM l"""

_STEPS_SQL = ", ".join(f"('{p}', {v}, '{name}', {mask_of(wanted)}, {mask_of([name])})" for p, v, wanted in POLICIES for name in wanted)
ABLATION_ORACLE = f"""WITH {_ledger_sql()}, s(policy, version, rule, mask, bit) AS (VALUES {_STEPS_SQL})
SELECT policy, version, rule, count(failed) AS n_docs, count(CASE WHEN failed & mask = 0 THEN 1 END) AS n_kept, count(CASE WHEN failed & bit <> 0 THEN 1 END) AS n_failed,
 count(CASE WHEN failed & mask = bit THEN 1 END) AS n_only, CAST(coalesce(bit_or(CASE WHEN failed & bit <> 0 THEN failed & mask - bit END), 0) AS BIGINT) AS also,
 CAST(coalesce(bit_and(CASE WHEN failed & bit <> 0 THEN (failed & mask) - bit END), 0) AS BIGINT) AS always FROM s LEFT JOIN l ON true GROUP BY ALL"""

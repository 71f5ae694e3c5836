"""Awkward documents that every operator must handle."""

from __future__ import annotations

import random

import pytest

#: Extra columns under names that the operators use for themselves.
EXTRA = ("row", "key", "doc", "gid", "bucket", "size", "kept", "keep_id", "class_id", "score", "lang_pred", "start", "at", "block",
         "_near_key", "_stay_id", "_stay_key", "_mix_text", "_mix_id", "_mix_key", "_mix_times", "_mix_copy", "_text", "words", "part", "mask", "n", "rank", "times")
SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{e}` string" for e in EXTRA)


def words(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abdeghilmnorstu") for _ in range(pick.randint(2, 8))) for _ in range(n))


def rows_of_documents():
    """(doc_id, text, lang, source)."""
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),  # exact copy
        (3, near, "en", None),  # near copy
        (4, None, None, "b"),
        (5, "", "en", "b"),
        (6, "   \n\t ", "de", "b"),
        (7, words(7, 30000), "de", "a"),  # very long
        (8, "ab" * 400, "de", "c"),  # repeats itself
        (9, "ab" * 400 + words(9, 50), None, "c"),
        (10, words(10, 40), "fr", "c"),
        (10, words(11, 40), "fr", "c"),  # the same doc_id again
        (12, words(12, 60), "fr", "d"),
        (12, words(12, 60), "fr", "d"),  # a repeated row
        (None, words(13, 60), "en", None),
        (None, base, "en", "a"),
        (16, "Grüße an Zoë 漢字 😀 " + words(16, 30), "de", "e"),
        (17, "three short words", "en", "e"),
        (18, "three short words", "en", "e"),
        (19, "12345 67890 !!! ???", "en", "e"),
    ]


def collected(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(*r, *["x"] * len(EXTRA)) for r in rows_of_documents()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

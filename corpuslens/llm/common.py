"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.session import cut_lineage, scratch_path, ship_with_tasks  # noqa: F401

ship_with_tasks(__name__)

#: Rows of one Arrow batch at most: long texts must not pile up in a Python worker.
BATCH_ROWS = 1000

#: Words are runs of ASCII digits, ASCII letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ... as a byte table: capital letters become small, what is no word becomes a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches at ``BATCH_ROWS`` rows or fewer in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_hash(text: str = "text") -> Column:
    """Second half of a document's identity: rows that share a doc_id are told apart by it."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def unused_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``docs`` has them (Spark ignores case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def folded(text: bytes) -> list[bytes]:
    """The words of a text in small letters (only A-Z is folded)."""
    return text.translate(_FOLD).split()


def folded_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends in that string."""
    line = b" ".join(folded(text))
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if not line:
        return line, spaces, spaces
    return line, np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(line)]])


def output_folder(spark: SparkSession, label: str) -> str:
    """A new shared folder as a URI that every executor understands."""
    path = scratch_path(spark, label)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def open_output(folder: str, name: str):
    """(stream, path) of a new file; the name is unique, so a task that runs twice leaves a second
    file which no manifest names."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    return store.open_output_stream(path), f"{folder}/{path.rsplit('/', 1)[1]}"


def open_input(path: str):
    """A seekable input file for a path that ``open_output`` gave."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Corpus source: whole files from storage as ``files(project, path, text, size_bytes)``."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.text import glob_regex
from corpuslens.session import ship_with_tasks
from corpuslens.sources.stored import tree_store

ship_with_tasks(__name__)


def read_corpus(
    spark: SparkSession, root: str, max_kb: int = 500, globs=fixed.EXCLUDE_GLOBS, glob_filter: str | None = None
) -> DataFrame:
    """Recursive read of ``root/<project>/...``: project, path, text, size_bytes, skipped.

    The tree is listed by tasks, one entry of the root each, and opened by others; Spark's own source would
    send the status of every file to the driver. Files above the size limit are not opened. They stay as rows with a null text and ``skipped`` = ``oversize``.
    Binary files (a zero byte in the first 8192) have a null text and ``skipped`` = ``binary``.
    Empty files and names with a dot or an underscore in front are left out, as Spark's file sources do; ``stored.tree_listing`` and
    ``stored.opened`` do.
    """
    limit = max_kb * 1024
    named = (F.col("path").rlike(glob_regex(tuple(globs))) | F.col("at").rlike(HIDDEN))
    listing = _listing(spark, root).where(~named & (F.col("size_bytes") > 0))
    if glob_filter:
        listing = listing.where(F.substring_index("at", "/", -1).rlike(_hadoop_glob(glob_filter)))
    # the rows are small, what they name isn't: dealt to tasks by their names
    listing = listing.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "at")
    found = listing.mapInArrow(_opener(root, limit), f"{LISTED}, content binary")
    binary = F.contains(F.substring(F.col("content"), 1, 8192), F.lit(bytearray(b"\x00")))
    return found.select(
        "project", "path", F.when(~binary, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), "size_bytes",
        F.when(F.col("size_bytes") > limit, "oversize").when(binary, "binary").alias("skipped"))


#: names that Spark's file sources don't list
HIDDEN = r"(^|/)([.]|_(?!(common_)?metadata)[^/=]*(/|$))|[.]_COPYING_(/|$)"
LISTED = "project string, path string, at string, size_bytes bigint"


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """``LISTED``, one row per file (``at``: its path below the root). The driver names the entries of the
    root; what lies below them is listed by tasks, no list of files comes to the driver."""
    from pyarrow import fs

    store, base = tree_store(root)
    entries = store.get_file_info(fs.FileSelector(base))
    tops = [(i.base_name, i.size if i.is_file else None) for i in entries]
    names = spark.createDataFrame(tops, "top string, size bigint").repartition(max(1, min(len(tops), 1000)))

    def run(batches):
        store, base = tree_store(root)
        for batch in batches:
            for top, size in zip(*(batch.column(c).to_pylist() for c in ("top", "size"))):
                if size is not None:
                    rows = [(top, top, top, size)]
                else:
                    files = (i for i in store.get_file_info(fs.FileSelector(f"{base}/{top}", recursive=True)) if i.is_file)
                    rows = [(top, i.path[len(f"{base}/{top}/"):], i.path[len(base) + 1:], i.size) for i in files]
                for k in range(0, len(rows), 10_000):
                    project, path, at, sizes = zip(*rows[k:k + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(project, pa.string()), pa.array(path, pa.string()), pa.array(at, pa.string()), pa.array(sizes, pa.int64())],
                        names=["project", "path", "at", "size_bytes"])

    return names.mapInArrow(run, LISTED)


def _opener(root: str, limit: int, together: int = 1 << 23):
    """Rows of a listing with the content of the files up to ``limit`` bytes, some ``together`` bytes a batch."""
    kinds = pa.schema([("project", pa.string()), ("path", pa.string()), ("at", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])

    def run(batches):
        store, base = tree_store(root)
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                content = None
                if row["size_bytes"] <= limit:
                    with store.open_input_stream(f"{base}/{row['at']}") as stream:
                        content = stream.read()
                    size += len(content)
                rows.append(row | {"content": content})
                if size >= together:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return run


def _hadoop_glob(glob: str) -> str:
    """A file-name glob of Hadoop (``*``, ``?``, ``[a-z]``, ``{a,b}``) as a regex."""
    out, deep, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and "]" in glob[i + 1:]:
            end = glob.index("]", i + 1)
            inner = glob[i + 1:end]
            out += "[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner) + "]"
            i = end
        elif c == "{":
            out, deep = out + "(?:", deep + 1
        elif c == "}" and deep:
            out, deep = out + ")", deep - 1
        else:
            out += "|" if c == "," and deep else re.escape(c)
        i += 1
    return f"(?s)^{out}$"

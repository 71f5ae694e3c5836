"""Stored tables that micro-batches are merged into, and scans that open only what changed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.functions.text import glob_regex, parent_dirs
from corpuslens.functions import fixed
from corpuslens.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

PARTS = 64  #: hash partitions of a stored table


# ---- upserts ------------------------------------------------------------------------
def create_stored(spark: SparkSession, path: str, schema: str) -> None:
    """An empty stored table."""
    spark.createDataFrame([], f"{schema}, _batch bigint, _part int").write.mode("error").partitionBy("_part").parquet(path)
    spark.createDataFrame([], f"{schema}, _batch bigint").write.parquet(f"{path}/_part=-1")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_batch", "_part")


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], merge: dict[str, Column], batch: int, parts: int = PARTS) -> None:
    """Merges ``updates`` into the table at ``path``, one row per key afterwards.

    ``merge`` says for each other column how the stored row and the new rows of a key make one
    (aggregates over the columns of the table; ``_batch`` is -1 at most for nothing, older for stored rows).
    The table lies in ``parts`` folders by hash of the key; only folders that hold a key of the batch are
    read, and only they are replaced. Batches have rising numbers. A batch that is repeated changes
    nothing: a key that has seen its number or a later one takes no part. Null keys are keys.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = cut_lineage(updates.select(*keys, *merge, F.lit(batch).cast("bigint").alias("_batch"), part.alias("_part")), "updates")
    touched = [r[0] for r in new.select("_part").distinct().collect()]  # ``parts`` numbers at most
    if not touched:
        return
    known = spark.read.schema(new.schema).parquet(path).where(F.col("_part").isin(touched))
    old = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_batch").alias("_seen"))
    same = [new[k].eqNullSafe(old[f"_k{i}"]) for i, k in enumerate(keys)]
    unseen = new.join(old.where(F.col("_seen") >= batch), same, "left_anti")
    rows = known.select(*new.columns).unionByName(unseen).groupBy("_part", *keys).agg(
        *[c.alias(name) for name, c in merge.items()], F.max("_batch").alias("_batch"))
    # the folders of the batch are replaced as a whole, all others keep their files
    cut_lineage(rows.select(*keys, *merge, "_batch", "_part"), "merged").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)


def upsert_machines(spark: SparkSession, path: str, activity: DataFrame, batch: int) -> None:
    """Activations of a batch (licence, machine, first and last use) into the stored machines."""
    upsert(spark, path, activity, ["license_id", "machine_id"], {"first_seen": F.min("first_seen"), "last_seen": F.max("last_seen")}, batch)


def upsert_users(spark: SparkSession, path: str, logins: DataFrame, batch: int) -> None:
    """Logins of a batch (github_id, username, ts, login_id) into the stored users: the newest name wins,
    the first sight is kept. Logins are reduced to one row per account first."""
    latest = logins.groupBy("github_id").agg(
        F.max_by("username", F.struct("ts", "login_id")).alias("username"), F.min("ts").alias("created_at"), F.max("ts").alias("last_login"))
    upsert(spark, path, latest, ["github_id"], {
        "username": F.max_by("username", F.struct("last_login", "_batch")), "created_at": F.min("created_at"), "last_login": F.max("last_login")}, batch)


# ---- trees of files -----------------------------------------------------------------
def write_corpus(files: DataFrame, root: str) -> int:
    """Writes ``files`` (project, path, text) as ``root/<project>/<path>``; gives their number. A null text is an
    empty file. The root is a folder that all executors reach."""
    def run(batches):
        store, base = tree_store(root)
        for batch in batches:
            for project, path, text in zip(*(batch.column(c).to_pylist() for c in ("project", "path", "text"))):
                at = f"{base}/{project}/{path}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("project", "path", "text").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def tree_store(root: str):
    """(pyarrow file system, folder) of a root."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if re.match(r"^[a-z0-9]+:", root) else f"file://{root}")


LISTING = "project string, path string, size_bytes bigint, modified timestamp"
FINGERPRINTS = f"{LISTING}, sha256 string"


def tree_listing(spark: SparkSession, root: str, globs=fixed.EXCLUDE_GLOBS) -> DataFrame:
    """``LISTING`` of every file of ``root/<project>/...``, hidden ones too; none is opened. A project is listed
    by one task."""
    from pyarrow import fs

    store, base = tree_store(root)
    projects = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
    names = spark.createDataFrame(projects, "project string").repartition(max(1, min(len(projects), 1000)))

    def run(batches):
        store, base = tree_store(root)
        for batch in batches:
            for project in batch.column("project").to_pylist():
                top = f"{base}/{project}"
                found = [i for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([project] * len(found), pa.string()), pa.array([i.path[len(top) + 1:] for i in found], pa.string()),
                     pa.array([i.size for i in found], pa.int64()), pa.array([i.mtime for i in found], pa.timestamp("us", "UTC"))],
                    names=["project", "path", "size_bytes", "modified"])

    return names.mapInArrow(run, LISTING).where(~F.col("path").rlike(glob_regex(tuple(globs))))


def opened(listing: DataFrame, root: str, max_kb: int = 500) -> DataFrame:
    """``LISTING`` with text, skipped and sha256 of the content: each file is opened once, by the task that has
    its row. Oversize files aren't opened, ``skipped`` says so, and their digest is that of size and time;
    binary files (a zero byte in the first 8192) have no text; what isn't UTF-8 is replaced."""
    def run(batches):
        store, base = tree_store(root)
        for batch in batches:
            for row in batch.to_pylist():
                big = row["size_bytes"] > max_kb * 1024
                data = f"{row['size_bytes']} {row['modified']}".encode()
                if not big:
                    with store.open_input_stream(f"{base}/{row['project']}/{row['path']}") as stream:
                        data = stream.read()
                binary = not big and b"\x00" in data[:8192]
                row |= {"text": None if big or binary else data.decode("utf-8", "replace"), "skipped": "oversize" if big else "binary" if binary else None,
                        "sha256": hashlib.sha256(data).hexdigest()}
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    kinds = pa.schema([("project", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")),
                       ("text", pa.string()), ("skipped", pa.string()), ("sha256", pa.string())])
    return listing.mapInArrow(run, f"{LISTING}, text string, skipped string, sha256 string")


def changed_files(spark: SparkSession, root: str, known: DataFrame | None = None, max_kb: int = 500, globs=fixed.EXCLUDE_GLOBS) -> tuple[DataFrame, DataFrame]:
    """(texts, fingerprints) of a tree of files against the ``FINGERPRINTS`` of an earlier scan.

    The tree is listed without opening a file. Only files that are new, or whose size or time of change is
    not the known one, are opened: ``texts`` holds those whose content differs (project, path, text,
    size_bytes, skipped), ``fingerprints`` one row for every file that is there now. A file that was merely
    touched gets its new time, and no text. Files that are gone have no row.
    """
    listing = cut_lineage(tree_listing(spark, root, globs), "listing")
    old = spark.createDataFrame([], FINGERPRINTS) if known is None else known
    same = ["project", "path", "size_bytes", "modified"]
    fresh = cut_lineage(opened(listing.join(old.select(*same), same, "left_anti"), root, max_kb), "opened")
    news = fresh.join(old.select("project", "path", "sha256"), ["project", "path", "sha256"], "left_anti")
    told = listing.join(old, same).select(*same, "sha256").unionByName(fresh.select(*same, "sha256"))
    return news.select("project", "path", "text", "size_bytes", "skipped"), told


def folder_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """project, folder, n_files, fingerprint of every folder with all that lies below it ('' is the project);
    sums and exclusive ors of hashes, so that they are made of parts in any order."""
    folders = F.concat(F.array(F.lit("")), parent_dirs("path"))
    one = F.xxhash64("path", "sha256")
    rows = fingerprints.select("project", F.explode(folders).alias("folder"), one.alias("h"))
    return rows.groupBy("project", "folder").agg(
        F.count("*").alias("n_files"), F.concat_ws(":", F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).alias("fingerprint"))


def folders_to_scan(before: DataFrame, after: DataFrame) -> DataFrame:
    """project, folder, action: ``skip`` for folders whose fingerprint is as it was, else ``scan``; folders
    that are gone are left out."""
    old = folder_fingerprints(before).select("project", "folder", F.col("fingerprint").alias("old"))
    return folder_fingerprints(after).join(old, ["project", "folder"], "left").select(
        "project", "folder", F.when(F.col("fingerprint") == F.col("old"), "skip").otherwise("scan").alias("action"))

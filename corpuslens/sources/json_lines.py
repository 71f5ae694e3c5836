"""Folders of JSON-line logs as one Spark data source for batch and stream.

A file is a session and may still grow. Lines are named by their byte offset, so that a large file is read
by many tasks, and a stream goes on in a file where it stopped: its offset says per file how many bytes
were taken, up to the last whole line. Lines that are no JSON come as rows too, marked as such, so they
can be counted. Files are opened where their rows are needed, and only files of sessions that are asked for.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from corpuslens.session import ship_with_tasks

ship_with_tasks(__name__)

SCHEMA = "session string, pos bigint, line string, valid boolean"
PART_BYTES = 32 << 20  #: bytes of a file that one task reads


class _Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+:", path) else f"file://{path}")


def _sizes(path: str) -> dict[str, int]:
    from pyarrow import fs

    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return {i.path[len(base):].lstrip("/"): i.size for i in found if i.is_file and not re.search(r"(^|/)[._]", i.path[len(base):].lstrip("/"))}


def _session(name: str) -> str:
    return re.sub(r"\.[A-Za-z]+$", "", name.rsplit("/", 1)[-1])


def _pieces(name: str, start: int, end: int) -> list[_Piece]:
    return [_Piece(name, at, min(at + PART_BYTES, end)) for at in range(start, end, PART_BYTES)]


def _is_json(line: bytes) -> bool:
    try:
        json.loads(line)
        return True
    except ValueError:
        return False


def _lines(path: str, piece: _Piece, keep_open_end: bool) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the piece; a last line without a break counts only if ``keep_open_end``."""
    store, base = _store(path)
    rows: list[tuple] = []

    def batch():
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["session", "pos", "line", "valid"])

    with io.BufferedReader(store.open_input_file(f"{base}/{piece.name}"), 1 << 16) as file:
        at = piece.start
        if at:  # a line that begins before the piece belongs to the piece before it
            file.seek(at - 1)
            at += len(file.readline()) - 1
        file.seek(at)
        while at < piece.end:
            line = file.readline()
            if not line or not (line.endswith(b"\n") or keep_open_end):
                break
            if line.strip():
                rows.append((_session(piece.name), at, line.rstrip(b"\r\n").decode("utf-8", "replace"), _is_json(line)))
            at += len(line)
            if len(rows) >= 1000:
                yield batch()
                rows = []
    if rows:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.sessions = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("session",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("session",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.sessions = wanted if self.sessions is None else self.sessions & wanted

    def partitions(self) -> list[InputPartition]:
        sizes = _sizes(self.path)
        return [p for name, size in sorted(sizes.items()) if self.sessions is None or _session(name) in self.sessions for p in _pieces(name, 0, size)] or [_Piece("", 0, 0)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition, True) if partition.end else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are {file: bytes taken}; they name every file of the folder, so old files belong elsewhere."""

    def __init__(self, path: str):
        self.path, self.at = path, None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, base = _store(self.path)
        offset = dict(self.at or {})
        for name, size in sorted(_sizes(self.path).items()):
            done = offset.get(name, 0)
            if size <= done:
                continue
            with store.open_input_file(f"{base}/{name}") as file:  # up to the last whole line
                end, tail = size, b""
                while end > done and b"\n" not in tail:
                    start = max(done, end - 65536)
                    file.seek(start)
                    tail, end = file.read(end - start), start
            if b"\n" in tail:
                offset[name] = end + tail.rindex(b"\n") + 1
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        return [p for name, upto in sorted(end.items()) if upto > start.get(name, 0) for p in _pieces(name, start.get(name, 0), upto)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition, False)

    def commit(self, end: dict) -> None:
        pass


class JsonLines(DataSource):
    """``spark.read.format("json_lines").load(folder)``, ``spark.readStream...`` likewise."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLines)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, pos, line, valid) of a folder of logs."""
    _registered(spark)
    return spark.read.format("json_lines").load(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream; each line once, also where files grow or the stream is stopped and started again."""
    _registered(spark)
    return spark.readStream.format("json_lines").load(path)

"""Named queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslens.sources.bindings import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def _counted(sql: str) -> str:
    """``count_if(x)`` as ``count(CASE WHEN x THEN 1 END)``: the first is a 128-bit sum in DuckDB."""
    word = "count_if("
    while word in sql:
        begin = sql.index(word)
        at, depth = begin + len(word), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        inner = sql[begin + len(word):at - 1]
        sql = f"{sql[:begin]}count(CASE WHEN {inner} THEN 1 END){sql[at:]}"
    return sql


def query(name: str, covers: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query. ``covers`` lists inventory ids, ``views`` the derived views of ``sql``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = _counted(with_views(sql, *views.split()))
        return fn

    return add

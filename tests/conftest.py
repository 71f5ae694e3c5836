"""Shared local session and small helpers."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "corpuslens-tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__default__parallelism="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """files(project, path, text) from {project: {path: text}}."""
    def make(projects):
        rows = [(p, path, text) for p, tree in projects.items() for path, text in tree.items()]
        return spark.createDataFrame(rows, "project string, path string, text string")

    return make


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)

"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "corpuslens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on (UTC clock, AQE, no web page)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder that all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master (tests) may fall
    back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corpuslens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_with_tasks(module_name: str) -> None:
    """Python functions of a module travel inside the task, so that executors need no copy of
    this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def local_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A short fixed list as a local relation: no Python worker is started to read it."""
    import pandas as pd
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame(pd.DataFrame(list(rows), columns=names, dtype=object), schema)

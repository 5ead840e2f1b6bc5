"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def folder_of(spark) -> str:
    """``spark.checkpoint.dir``; where it is not set, a local master uses a folder of this process and any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and its lineage ends at files that all executors see."""
    path = f"{folder_of(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

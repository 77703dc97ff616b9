"""Reuse of a small intermediate table within one plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and one machine does all work, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"surfmatch-{os.getuid()}")
    return base.rstrip("/")


def reused(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, for its several readers; for aggregates, not for pairs.

    Plans end at the table: they stay small however many steps follow each other, its size
    is known to the optimizer, and what a lost executor held is read again, not computed again.
    """
    path = f"{shared_folder(df.sparkSession)}/reused-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

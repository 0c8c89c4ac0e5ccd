"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def own_folder() -> str:
    """A folder for sessions that name none, as in tests on one machine."""
    return tempfile.mkdtemp(prefix="spark-scratch-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place under ``spark.checkpoint.dir``; a folder of this machine only for sessions in local mode that name none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or own_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and read it back, so later steps do not compute it again."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

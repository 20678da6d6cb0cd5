"""Materialising a frame in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _prepared(spark: SparkSession) -> str:
    """The folder of checkpoints, which the context is told of where it has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="weftline-"))
    return spark.sparkContext.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that driver and executors share."""
    return f"{_prepared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint of `df` in the folder of `spark.checkpoint.dir`: its lineage ends there.

    Only a local session may lack the setting; it gets a folder of its own.
    """
    _prepared(df.sparkSession)
    return df.checkpoint()

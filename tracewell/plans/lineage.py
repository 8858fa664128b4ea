"""Cutting lineage in loops by reliable checkpoints, and a place for files, in the folder the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one of our own in local mode (tests) alone, as only there all tasks share it."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or os.path.join(tempfile.gettempdir(), "tracewell-checkpoints")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(), in the session's folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for files of this application."""
    return f"{shared_folder(spark)}/files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

"""Cutting the lineage of loops."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder in that of spark.checkpoint.dir. Only a local session that names none, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

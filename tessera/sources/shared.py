"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def materialise(df: DataFrame) -> DataFrame:
    """df as written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a session on one machine gets a
    temporary folder; on a cluster it is an error."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context.getCheckpointDir()

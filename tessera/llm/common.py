"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separator of this subpackage.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir.

    A session without one gets a temporary folder if it is on one machine (as in tests); on a
    cluster that is an error, since executors don't see each other's folders.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"checkpoint-{os.getpid()}-"))
    return named or context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, whichever that is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


class Scratch:
    """Tables that an operator writes to the shared folder while it runs, as Parquet.

    Lost executors cost no recomputation, small files are read together, and what is no longer
    needed goes at once: drop() deletes tables, close() all of them. Both also have the driver's
    JVM look for shuffles that nothing refers to any more, whose files Spark then deletes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self._paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}
        self.tasks = 2 * spark.sparkContext.defaultParallelism

    def keep(self, df: DataFrame, wide: bool = False) -> DataFrame:
        """df as written. Unless it is wide (made from texts, a task of its own for each piece), it is
        written by a few tasks a core at most, whatever number of partitions it has."""
        path = f"{self.top}/{len(self._paths)}"
        df = df if wide else df.coalesce(self.tasks)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path, held in self._paths.items():
            if any(held is t for t in tables):
                remove(self.spark, path)
                self._paths[path] = None
        self.spark._jvm.System.gc()

    def close(self) -> None:
        self._paths = {}
        remove(self.spark, self.top)
        self.spark._jvm.System.gc()


#: What one Arrow batch between the JVM and a worker may take, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_BYTES, as rows are whole texts and both sides buffer a batch. A
    session that was started with its own limit keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH_BYTES)


def materialise(df: DataFrame) -> DataFrame:
    """df as written to the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Vectors that arrive over time: an index of slices, appended by a stream and read as a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ivf import IvfIndex
from tessera.operators.topk import merge


class SlidingIndex:
    """Slices of an index under one folder, partitioned by slice and list.

    append() adds a slice, stream() one a micro-batch (a repeated batch overwrites its own slice, so
    a restart doesn't double it), window() reads the newest ones, expire() drops old ones.
    """

    def __init__(self, spark: SparkSession, index: IvfIndex, path: str):
        self.spark, self.index, self.path = spark, index, path

    def append(self, vectors: DataFrame, slice_id: int) -> None:
        rows = self.index.reset().placed(vectors)
        rows.sortWithinPartitions("list_id", "r").write.mode("overwrite").parquet(f"{self.path}/slice_id={slice_id}")

    def stream(self, vectors: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a query that makes a slice of every micro-batch."""
        writer = vectors.writeStream.foreachBatch(lambda batch, number: self.append(batch, number)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def slices(self) -> list[int]:
        return sorted(r[0] for r in self.rows().select("slice_id").distinct().collect())

    def window(self, width: int) -> IvfIndex:
        """An index over the newest `width` slices; others are pruned by their partition."""
        newest = self.slices()[-width:]
        return self.index.subset_of(self.rows().filter(F.col("slice_id").isin(newest)).drop("slice_id"))

    def expire(self, width: int) -> list[int]:
        """Deletes all but the newest `width` slices; those it deleted."""
        old = self.slices()[:-width]
        jvm = self.spark.sparkContext._jvm
        for s in old:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/slice_id={s}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return old


def running_top_k(results: list[DataFrame], k: int, greater: bool = False) -> DataFrame:
    """The result over all blocks of a base so far, from those of its blocks."""
    return merge(results, k, greater)

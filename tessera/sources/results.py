"""Search results and metrics in files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(results: DataFrame, path: str) -> None:
    """A line a query: its id, then `id distance` pairs by rank."""
    pair = F.concat_ws(" ", F.col("vec_id").cast("string"), F.col("distance").cast("string"))
    lines = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", pair.alias("p")))).alias("ps"))
    text = F.concat_ws(" ", F.col("qid").cast("string"), F.array_join(F.transform("ps", lambda x: x["p"]), " "))
    lines.orderBy("qid").select(text.alias("value")).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """qid, rank, vec_id, distance."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    each = parts.select(F.get("p", F.lit(0)).cast("long").alias("qid"), "p", F.explode(F.sequence(F.lit(1), F.expr("(size(p) - 1) div 2"))).alias("rank"))
    return each.select("qid", F.col("rank").cast("int").alias("rank"), F.get("p", 2 * F.col("rank") - 1).cast("long").alias("vec_id"), F.get("p", 2 * F.col("rank")).cast("double").alias("distance"))


def write_raw(results: DataFrame, path: str, k: int) -> int:
    """One binary file: the ids of all queries in order of their id, k each, as 64-bit numbers, then
    the distances as 32-bit ones; -1 and the greatest float where there are fewer. How many queries.

    The layout is one sequential file, so it has one writer, which holds a partition at a time.
    """
    spark = results.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    each = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("found")).orderBy("qid")
    stream, n = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True), 0
    try:
        for column, kind, fill in (("vec_id", "<i8", -1), ("distance", "<f4", np.finfo(np.float32).max)):
            n = 0
            for row in each.toLocalIterator():
                values = [x[column] for x in row["found"]][:k]
                stream.write((np.array(values + [fill] * (k - len(values)))).astype(kind).tobytes())
                n += 1
    finally:
        stream.close()
    return n


def read_raw(spark: SparkSession, path: str, k: int) -> DataFrame:
    """qid (numbered from 0), rank, vec_id, distance of a file as write_raw makes it, of at most 2 GB."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_buffer()
                n = len(raw) // (12 * k)
                ids, d = np.frombuffer(raw, "<i8", n * k), np.frombuffer(raw, "<f4", n * k, 8 * n * k)
                at = np.flatnonzero(ids >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array((at % k + 1).astype(np.int32)), pa.array(ids[at]), pa.array(d[at].astype(float))], names=["qid", "rank", "vec_id", "distance"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "qid long, rank int, vec_id long, distance double")


def write_parquet(results: DataFrame, path: str) -> None:
    results.repartitionByRange("qid").sortWithinPartitions("qid", "rank").write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Rows of a run log; every part file has its header."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)

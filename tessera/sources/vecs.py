"""fvecs, ivecs and bvecs files: records of a 32-bit dimension and as many components.

Records have one length, so a file of any size is read in splits at record boundaries, through the
Hadoop file system and thus from any store. A record's number is its id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {".fvecs": ("<f4", 4), ".ivecs": ("<i4", 4), ".bvecs": ("u1", 1)}


def _kind(path: str) -> tuple[str, int]:
    for ending, kind in _KINDS.items():
        if path.endswith(ending):
            return kind
    raise ValueError(f"none of {', '.join(_KINDS)}: {path}")


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _file(spark, path)
    return store.exists(where)


def info(spark: SparkSession, path: str) -> tuple[int, int]:
    """(vectors, dimension), from the first record's head and the file's length."""
    width = _kind(path)[1]
    where, store = _file(spark, path)
    size = store.getFileStatus(where).getLen()
    if size == 0:
        return 0, 0
    stream = store.open(where)
    try:
        d = struct.unpack("<i", bytes(stream.read() for _ in range(4)))[0]
    finally:
        stream.close()
    record = 4 + d * width
    if d <= 0 or size % record:
        raise ValueError(f"{path} isn't made of records of {d} components")
    return size // record, d


def read(spark: SparkSession, path: str, first: int = 1, last: int = 0) -> DataFrame:
    """vec_id, embedding (float) of records first .. last, counted from 1; last 0 is the end."""
    dtype, width = _kind(path)
    n, d = info(spark, path)
    if n == 0:
        return spark.createDataFrame([], "vec_id long, embedding array<float>")
    name = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(
        path, name, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{name}.recordLength": str(4 + width * d)}
    )

    def rows(part: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, list[float]]]:
        for number, raw in part:
            yield number, np.frombuffer(raw, dtype=dtype, offset=4).astype(float).tolist()

    out = spark.createDataFrame(records.mapPartitions(rows), "vec_id long, embedding array<float>")
    return out.filter((F.col("vec_id") >= first - 1) & (F.col("vec_id") < last if last else F.lit(True)))


def write(vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """One file in the order of the ids; how many records. The format is one sequential file, so it
    has one writer, which holds a partition at a time."""
    dtype, _ = _kind(path)
    where, store = _file(vectors.sparkSession, path)
    stream, n = store.create(where, True), 0
    try:
        for row in vectors.select(id_col, vector).orderBy(id_col).toLocalIterator():
            x = np.array(row[1]).astype(dtype)
            stream.write(struct.pack("<i", len(x)) + x.tobytes())
            n += 1
    finally:
        stream.close()
    return n

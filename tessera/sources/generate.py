"""Synthetic vectors, made where they are used: a seed gives the same rows on any cluster of the
same partition count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(spark: SparkSession, n: int, d: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select(F.col("id").alias("vec_id"), F.array(*[F.rand(seed + i).cast("float") for i in range(d)]).alias("embedding"))


def gaussian(spark: SparkSession, n: int, d: int, seed: int = 1, unit: bool = False) -> DataFrame:
    out = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed + i) for i in range(d)]).alias("embedding"))
    if unit:
        from tessera.functions.vectors import normalised

        out = out.withColumn("embedding", normalised(F.col("embedding")))
    return out


def whole_numbers(spark: SparkSession, n: int, d: int, most: int = 255, seed: int = 1) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.floor(F.rand(seed + i) * (most + 1)).cast("int") for i in range(d)]).alias("embedding"))


def latent(spark: SparkSession, n: int, d: int, rank: int = 10, seed: int = 1338, first_id: int = 0) -> DataFrame:
    """Smooth vectors of a low-dimensional origin: sines of a random map of a few Gaussians."""
    from tessera.operators.transform import mapped

    draw = np.random.Generator(np.random.PCG64(seed))
    a, b = draw.random((rank, d)), draw.random(d) * 4 + 0.1
    rows = gaussian(spark, n, rank, seed + 1 + first_id).withColumn("vec_id", F.col("vec_id") + first_id)
    return mapped(rows, lambda x: np.sin(x @ a * b))


def dataset(spark: SparkSession, d: int, n_train: int, n_base: int, n_query: int, seed: int = 1338) -> dict[str, DataFrame]:
    """train, base and query sets of one distribution."""
    return {name: latent(spark, n, d, seed=seed, first_id=i * 10_000_000).withColumn("vec_id", F.col("vec_id") - i * 10_000_000) for i, (name, n) in enumerate((("train", n_train), ("base", n_base), ("query", n_query)))}

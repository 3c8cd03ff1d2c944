"""Data sets by name: folders of vector files under one root, with their splits, and a made one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import generate, vecs

#: Where published sets have their files, and under which metric they are searched.
LAYOUTS = {
    "sift1M": {"folder": "sift1M", "train": "sift_learn.fvecs", "base": "sift_base.fvecs", "query": "sift_query.fvecs", "truth": "sift_groundtruth.ivecs", "metric": "l2"},
    "gist1M": {"folder": "gist1M", "train": "gist_learn.fvecs", "base": "gist_base.fvecs", "query": "gist_query.fvecs", "truth": "gist_groundtruth.ivecs", "metric": "l2"},
    "bigann": {"folder": "bigann", "train": "bigann_learn.bvecs", "base": "bigann_base.bvecs", "query": "bigann_query.bvecs", "truth": "gnd/idx_1000M.ivecs", "metric": "l2"},
    "deep1B": {"folder": "deep1b", "train": "learn.fvecs", "base": "base.fvecs", "query": "deep1B_queries.fvecs", "truth": "deep1B_groundtruth.ivecs", "metric": "l2"},
    "glove": {"folder": "glove", "train": "glove_base.fvecs", "base": "glove_base.fvecs", "query": "glove_query.fvecs", "truth": "glove_groundtruth.ivecs", "metric": "ip"},
    "music100": {"folder": "music-100", "train": "database_music100.fvecs", "base": "database_music100.fvecs", "query": "query_music100.fvecs", "truth": "", "metric": "ip"},
}


@dataclass
class Dataset:
    """train, base and query are (vec_id or qid, embedding); truth is (qid, rank, vec_id) or None."""

    train: DataFrame
    base: DataFrame
    query: DataFrame
    truth: DataFrame | None
    metric: str = "l2"

    def blocks(self, splits: int) -> Iterator[DataFrame]:
        """The base in parts of consecutive ids."""
        n = self.base.agg(F.max("vec_id")).first()[0]
        step = -(-(n + 1) // splits) if n is not None else 0
        for i in range(splits if step else 0):
            yield self.base.filter((F.col("vec_id") >= i * step) & (F.col("vec_id") < (i + 1) * step))


def cached(spark: SparkSession, path: str, last: int = 0) -> DataFrame:
    """The first `last` vectors of a file (0: all), from a Parquet copy beside it, which is made first
    where there is none."""
    copy = f"{path}.{last or 'all'}.parquet"
    if not vecs.exists(spark, f"{copy}/_SUCCESS"):
        vecs.read(spark, path, 1, last).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)


def load(spark: SparkSession, root: str, name: str, base_rows: int = 0, read=cached) -> Dataset:
    """A named set under root; base_rows: only so many vectors of the base."""
    if name not in LAYOUTS:
        raise ValueError(f"no such data set: {name}; there are {', '.join(LAYOUTS)}")
    at = LAYOUTS[name]
    path = lambda kind: f"{root}/{at['folder']}/{at[kind]}"
    truth = None
    if at["truth"] and vecs.exists(spark, path("truth")):
        each = read(spark, path("truth")).select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("pos", "v"))
        truth = each.select("qid", (F.col("pos") + 1).alias("rank"), F.col("v").cast("long").alias("vec_id"))
    query = read(spark, path("query")).withColumnRenamed("vec_id", "qid")
    return Dataset(read(spark, path("train")), read(spark, path("base"), base_rows), query, truth, at["metric"])


def synthetic(spark: SparkSession, d: int, n_train: int, n_base: int, n_query: int, k: int = 10, metric: str = "l2", seed: int = 1338) -> Dataset:
    """A made set with its exact neighbours."""
    from tessera.operators.flat import knn

    sets = generate.dataset(spark, d, n_train, n_base, n_query, seed)
    query = sets["query"].withColumnRenamed("vec_id", "qid")
    return Dataset(sets["train"], sets["base"], query, knn(query, sets["base"], k, metric), metric)

"""Searches of large query tables: queries are dealt to lists, and lists meet their queries.

Queries and index rows of a list are cut into pieces of bounded size; each pair of pieces is one
group of a cogrouped map, which keeps k results a query. So a list with a third of all rows, or one
that a third of all queries probe, is many groups. Lists are searched in slices, each written to its
own folder: a search that was broken off goes on with the slices that aren't there yet.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import KERNELS, Best, matrix
from tessera.functions.vectors import METRICS
from tessera.operators.flat import RESULT, STEP
from tessera.operators.ivf import IvfIndex
from tessera.operators.topk import top_k
from tessera.sources.vecs import exists

ROWS, QUERIES = 1 << 16, 1 << 12


def _pieces(rows: DataFrame, most: int, id_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their piece of their list, list_id and its number of pieces)."""
    counts = rows.groupBy("list_id").agg(F.ceil(F.count("*") / most).cast("int").alias(f"{name}s"))
    return rows.join(counts, "list_id").withColumn(name, F.pmod(F.xxhash64(id_col), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), counts


def big_batch(index: IvfIndex, queries: DataFrame, k: int, nprobe: int, path: str, slices: int = 8, rows: int = ROWS, most: int = QUERIES) -> DataFrame:
    """qid, rank, vec_id, distance: as index.search, for query tables of any size.

    path: a folder of the shared file system for what is done; a second call with the same path
    reads what the first one finished.
    """
    spark, metric = queries.sparkSession, index.metric
    greater, kernel = METRICS[metric][1], KERNELS[metric]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        ids, q = left.column("qid").to_numpy(), matrix(left.column("embedding"))
        best = Best(len(ids), k, greater)
        for at in range(0, right.num_rows, STEP):
            part = right.slice(at, STEP)
            best.scan(q, matrix(part.column("embedding")), part.column("vec_id").to_numpy(), kernel)
        at, found, d = best.rows()
        return pa.table({"qid": ids[at], "vec_id": found, "distance": d})

    probes = index.coarse(queries, nprobe).select("qid", "list_id").join(queries.select("qid", "embedding"), "qid")
    for s in range(slices):
        if exists(spark, f"{path}/{s}/_SUCCESS"):
            continue
        own = F.pmod(F.xxhash64("list_id"), F.lit(slices)) == s
        asked, n_asked = _pieces(probes.filter(own), most, "qid", "ask")
        held, n_held = _pieces(index.rows.filter(own).select("list_id", "vec_id", "embedding"), rows, "vec_id", "hold")
        # each piece goes to all pieces of the other side that its list has there
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = asked.join(n_held, "list_id").withColumn("hold", every("holds")).drop("holds")
        held = held.join(n_asked, "list_id").withColumn("ask", every("asks")).drop("asks")
        key = ["list_id", "ask", "hold"]
        found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, RESULT)
        top_k(found, k, greater).select("qid", "vec_id", "distance").write.mode("overwrite").parquet(f"{path}/{s}")
    done = reduce(DataFrame.union, [spark.read.schema(RESULT).parquet(f"{path}/{s}") for s in range(slices)])
    return top_k(done, k, greater).select("qid", "rank", "vec_id", "distance")


def blocks_of(base: DataFrame, blocks: int, id_col: str = "vec_id"):
    """The base in so many parts, by a hash of the id."""
    for i in range(blocks):
        yield base.filter(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == i)


def running_knn(queries: DataFrame, base: DataFrame, k: int, path: str, blocks: int = 8, metric: str = "l2") -> DataFrame:
    """The exact result over a base that is taken block by block; the k best so far are written after
    each block, so a ground truth that was broken off goes on."""
    from tessera.operators.flat import knn

    spark, greater, best = queries.sparkSession, METRICS[metric][1], None
    for i, block in enumerate(blocks_of(base, blocks)):
        if not exists(spark, f"{path}/{i}/_SUCCESS"):
            found = knn(queries, block, k, metric).select("qid", "vec_id", "distance")
            found = found if best is None else found.unionByName(best)
            top_k(found, k, greater).select("qid", "vec_id", "distance").write.mode("overwrite").parquet(f"{path}/{i}")
        best = spark.read.schema(RESULT).parquet(f"{path}/{i}")
    return top_k(best, k, greater).select("qid", "rank", "vec_id", "distance")


__all__ = ["big_batch", "blocks_of", "running_knn"]

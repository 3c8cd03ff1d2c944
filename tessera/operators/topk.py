"""Top-k by group, merging of results, arg-min."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(d: Column) -> Column:
    """Distances are ranked after rounding to six decimals, ties by id."""
    return F.floor(d * 1e6 + 0.5) / F.lit(1e6)


def top_k(rows: DataFrame, k: int, greater: bool = False, by: str = "qid", distance: str = "distance", id_col: str = "vec_id") -> DataFrame:
    """The k best rows of each group with their rank, from 1. Spark limits groups before the shuffle."""
    order = F.col(distance).desc() if greater else F.col(distance).asc()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(id_col)))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def merge(results: list[DataFrame], k: int, greater: bool = False) -> DataFrame:
    """One result from those of shards or blocks."""
    parts = [r.select("qid", "vec_id", "distance") for r in results]
    return top_k(reduce(DataFrame.unionByName, parts), k, greater)


def nearest(rows: DataFrame, by: str = "qid", distance: str = "distance", id_col: str = "vec_id") -> DataFrame:
    """The best row of each group as a minimum of (distance, id): a partial aggregate, no sort."""
    best = F.min(F.struct(F.col(distance).alias("d"), F.col(id_col).alias("i"))).alias("best")
    return rows.groupBy(by).agg(best).select(by, F.col("best.i").alias(id_col), F.col("best.d").alias(distance))


def k_least_per_row(rows: DataFrame, values: str, k: int, greatest: bool = False) -> DataFrame:
    return rows.withColumn(values, F.slice(F.sort_array(values, asc=not greatest), 1, k))


def partition(rows: DataFrame, k: int, by: str = "qid", value: str = "distance", id_col: str = "vec_id") -> DataFrame:
    """by, threshold, n: the value that splits each group's k least from the rest (its greatest, if it
    has no more), and how many don't exceed it. Groups are cut to k rows before the shuffle."""
    edge = top_k(rows, k, by=by, distance=value, id_col=id_col).groupBy(by).agg(F.max(value).alias("threshold"))
    return rows.join(edge, by).filter(F.col(value) <= F.col("threshold")).groupBy(by, "threshold").agg(F.count("*").alias("n"))


def is_sorted(rows: DataFrame) -> DataFrame:
    """qid, in_order: whether ranks follow distances."""
    before = F.lag("distance").over(Window.partitionBy("qid").orderBy("rank"))
    return rows.withColumn("before", before).groupBy("qid").agg(F.min(F.coalesce(F.col("before") <= F.col("distance"), F.lit(True))).alias("in_order"))


def padded(results: DataFrame, queries: DataFrame, k: int, greater: bool = False) -> DataFrame:
    """Results with rows of id -1 and an extreme distance where fewer than k were found."""
    slots = queries.select("qid").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    worst = F.lit(-3.4028234663852886e38 if greater else 3.4028234663852886e38)
    joined = slots.join(results.select("qid", "rank", "vec_id", "distance"), ["qid", "rank"], "left")
    return joined.select("qid", "rank", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), F.coalesce("distance", worst).alias("distance"))

"""Statistics and upkeep of vector tables: sizes, duplicates, unions, list views, residuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def list_sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("list_id").agg(F.count("*").alias("n"))


def size_histogram(lists: DataFrame) -> DataFrame:
    """By number of binary digits of the size: how many lists."""
    return list_sizes(lists).groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("lists"))


def imbalance(lists: DataFrame) -> DataFrame:
    """One row: lists * sum of squared sizes / (sum of sizes)^2."""
    n = F.col("n").cast("double")
    return list_sizes(lists).agg((F.count("*") * F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("imbalance"))


def max_radius(rows: DataFrame) -> DataFrame:
    return rows.groupBy("list_id").agg(F.max("r").alias("r_max"))


def dimension_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """pos, n, mean, stddev, least, greatest, n_nan of each dimension."""
    x = vectors.select(F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    v = F.when(~F.isnan("v"), F.col("v"))
    return x.groupBy("pos").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.sum(F.isnan("v").cast("long")).alias("n_nan")
    )


def matrix_summary(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: vectors, different ones, least and greatest norm, zero vectors."""
    n = V.norm(F.col(vector))
    distinct = vectors.groupBy(vector).agg(F.count("*").alias("copies"), F.first(n).alias("norm"))
    return distinct.agg(F.sum("copies").alias("n"), F.count("*").alias("n_distinct"), F.min("norm").alias("least_norm"), F.max("norm").alias("greatest_norm"), F.sum((F.col("norm") == 0).cast("long") * F.col("copies")).alias("n_zero"))


def bit_histogram(codes: DataFrame, bits: str = "bits") -> DataFrame:
    """pos, ones: how often each bit is set."""
    return codes.select(F.posexplode(bits).alias("pos", "b")).groupBy("pos").agg(F.sum("b").alias("ones"))


def byte_histogram(codes: DataFrame, code: str = "code") -> DataFrame:
    """pos, byte, n: how often each value is at each place of the codes."""
    return codes.select(F.posexplode(code).alias("pos", "byte")).groupBy("pos", "byte").agg(F.count("*").alias("n"))


def distinct_codes(codes: DataFrame, code: str) -> DataFrame:
    """One representative id of each code."""
    return codes.groupBy(code).agg(F.min("vec_id").alias("vec_id"))


def deduplicated(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a different vector, map of every id to its representative)."""
    one = vectors.groupBy("embedding").agg(F.min("vec_id").alias("rep"))
    members = vectors.join(one, "embedding").select("vec_id", "rep")
    return one.select(F.col("rep").alias("vec_id"), "embedding"), members


def expanded(results: DataFrame, members: DataFrame, k: int | None = None) -> DataFrame:
    """Results over representatives with all their copies; with k, only with the copies that can be
    among the k best by (distance, id): the k least ids of each representative."""
    if k is not None:
        n = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
        members = members.withColumn("n", n).filter(F.col("n") <= k).drop("n")
    return results.withColumnRenamed("vec_id", "rep").join(members, "rep").drop("rep")


def bucket_sort(table: DataFrame, value: str, id_col: str = "vec_id") -> DataFrame:
    """value, begin, n: where each value's rows lie when the table is sorted by (value, id)."""
    counts = table.groupBy(value).agg(F.count("*").alias("n"))
    before = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)  # one row a value
    return counts.select(value, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), "n")


def union_with_offset(a: DataFrame, b: DataFrame, offset: int, column: str = "vec_id") -> DataFrame:
    """Rows of both, b's ids (or lists) moved by offset."""
    return a.unionByName(b.withColumn(column, F.col(column) + offset))


def stacked(lists: list[DataFrame]) -> DataFrame:
    """Lists of the same number joined one after another (horizontal stack)."""
    return reduce(DataFrame.unionByName, lists)


def stacked_below(lists: list[tuple[DataFrame, int]]) -> DataFrame:
    """(lists, how many) below each other: list numbers go on (vertical stack)."""
    out, offset = [], 0
    for rows, n in lists:
        out.append(rows.withColumn("list_id", F.col("list_id") + offset))
        offset += n
    return reduce(DataFrame.unionByName, out)


def masked(first: DataFrame, other: DataFrame) -> DataFrame:
    """Lists of `first`, and of `other` where `first` has none."""
    return first.unionByName(other.join(first.select("list_id").distinct(), "list_id", "left_anti"))


def without_long_lists(rows: DataFrame, most: int) -> DataFrame:
    """Lists of more than `most` rows count as stop words and are empty."""
    long = list_sizes(rows).filter(F.col("n") > most).select("list_id")
    return rows.join(long, "list_id", "left_anti")


def replaced(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """vectors with those of `changes` in place of their own."""
    return vectors.join(changes.select("vec_id"), "vec_id", "left_anti").unionByName(changes)


def residuals(vectors: DataFrame, lists: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, list_id, residual: what is left after the centroid."""
    at = vectors.join(lists.select("vec_id", "list_id"), "vec_id").join(centroids, "list_id")
    return at.select("vec_id", "list_id", V.subtract(F.col("embedding"), F.col("centroid")).alias("residual"))


def capped_probes(probes: DataFrame, sizes: DataFrame, max_codes: int) -> DataFrame:
    """Probes until max_codes candidates are reached; the probe that reaches it is the last."""
    before = Window.partitionBy("qid").orderBy("probe_rank").rowsBetween(Window.unboundedPreceding, -1)
    at = probes.join(sizes.select("list_id", "n"), "list_id", "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)))
    return at.filter(F.col("before") < max_codes).select("qid", "probe_rank", "list_id")


def looked_up(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """keys with the table's value, -1 where there is none."""
    return keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(-1)))


def slice_window(rows: DataFrame, newest: int, width: int, slice_col: str = "slice_id") -> DataFrame:
    """Rows of the last `width` slices; a filter on the partition column of a sliced table."""
    return rows.filter((F.col(slice_col) > newest - width) & (F.col(slice_col) <= newest))


def lists_by_size(rows: DataFrame) -> DataFrame:
    """list_id, n, place: lists in ascending order of size."""
    return list_sizes(rows).withColumn("place", F.row_number().over(Window.orderBy("n", "list_id")))


def split_dimensions(vectors: DataFrame, cuts: list[int], distance) -> Column:
    """Sum of a distance over slices of two vectors `a` and `b`, as split indexes add them up."""
    parts, at = [], 1
    for width in cuts:
        parts.append(distance(F.slice("a", at, width), F.slice("b", at, width)))
        at += width
    return reduce(lambda x, y: x + y, parts)

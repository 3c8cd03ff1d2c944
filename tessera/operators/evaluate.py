"""Measures of search results against a ground truth, and of tuning runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(results: DataFrame, truth: DataFrame, k: int, greater: bool = False) -> DataFrame:
    """One row: recall by distance (ties with the k-th count, as does a relative error of 1e-4) and by id."""
    best = truth.filter(F.col("rank") <= k).groupBy("qid").agg((F.min if greater else F.max)("distance").alias("edge"), F.count("*").alias("n"), F.collect_set("vec_id").alias("ids"))
    # the truth is used once, so that it is made once
    found = best.join(results.filter(F.col("rank") <= k).select("qid", "vec_id", "distance"), "qid", "left")
    near = F.col("distance") >= F.col("edge") if greater else F.col("distance") <= F.col("edge")
    near = near | (F.abs(F.col("distance") - F.col("edge")) < 1e-4 * F.abs(F.col("edge")))
    each = found.groupBy("qid").agg(F.first("n").alias("n"), F.sum(near.cast("long")).alias("near"), F.sum(F.array_contains("ids", F.col("vec_id")).cast("long")).alias("hits"))
    return each.agg((F.sum("near") / F.sum("n")).alias("recall"), (F.sum("hits") / F.sum("n")).alias("id_recall"))


def distance_ratio(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: sum of found distances by sum of true ones, less 1."""
    a = results.agg(F.sum("distance").alias("a"))
    return a.crossJoin(truth.agg(F.sum("distance").alias("b"))).select((F.col("a") / F.col("b") - 1).alias("r2"))


def one_recall_at(results: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """Share of queries whose true nearest is among their first r results."""
    first = truth.filter("rank = 1").select("qid", F.col("vec_id").alias("nearest"))
    hits = first.join(results.filter(F.col("rank") <= r), "qid", "left").groupBy("qid").agg(F.max((F.col("vec_id") == F.col("nearest")).cast("int")).alias("hit"))
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("one_recall"))


def intersection(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of the k nearest that both have."""
    a, b = (x.filter(F.col("rank") <= k).select("qid", "vec_id") for x in (results, truth))
    n = b.select("qid").distinct().agg(F.count("*").alias("n"))
    return a.join(b, ["qid", "vec_id"]).agg(F.count("*").alias("both")).crossJoin(n).select((F.col("both") / (F.col("n") * k)).alias("intersection"))


def range_precision_recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision and recall overall, and averaged over queries (1 where there is nothing to find)."""
    a = results.select("qid", "vec_id", F.lit(1).alias("a"))
    b = truth.select("qid", "vec_id", F.lit(1).alias("b"))
    each = a.join(b, ["qid", "vec_id"], "full").groupBy("qid").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both"))
    each = each.select("qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "b", "both")])
    share = lambda x, y: F.when(F.col(y) == 0, 1.0).otherwise(F.col(x) / F.col(y))
    return each.agg(
        (F.sum("both") / F.nullif(F.sum("a"), F.lit(0))).alias("precision"),
        (F.sum("both") / F.nullif(F.sum("b"), F.lit(0))).alias("recall"),
        F.avg(share("both", "a")).alias("mean_precision"),
        F.avg(share("both", "b")).alias("mean_recall"),
    )


def range_curve(results: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall for results cut at each threshold."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    cut = results.select("qid", "vec_id", "distance", t).filter("distance < threshold")
    hit = cut.join(truth.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    found = hit.groupBy("threshold").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("both"))
    total = truth.agg(F.count("*").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("threshold", (F.col("both") / F.col("n")).alias("precision"), (F.col("both") / F.col("total")).alias("recall"))


def agreeing_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, same: whether two results agree where distances tie (ids may swap within a tie)."""
    count = lambda x, n: x.groupBy("qid", "distance").agg(F.count("*").alias(n))
    joined = count(a, "x").join(count(b, "y"), ["qid", "distance"], "full")
    return joined.groupBy("qid").agg(F.min(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("same"))


def similarity(results: DataFrame, truth: DataFrame, epsilon: float = 1e-6, greater: bool = False) -> DataFrame:
    """One row: mean share of a query's results that are in the truth or no farther than its farthest
    there, by epsilon at most."""
    edge = truth.groupBy("qid").agg((F.min if greater else F.max)("distance").alias("edge"))
    same = truth.select("qid", "vec_id", F.lit(True).alias("same"))
    near = F.col("distance") >= F.col("edge") - epsilon if greater else F.col("distance") <= F.col("edge") + epsilon
    each = results.join(edge, "qid").join(same, ["qid", "vec_id"], "left").groupBy("qid").agg(F.avg((F.coalesce("same", F.lit(False)) | near).cast("double")).alias("share"))
    return each.agg(F.avg("share").alias("similarity"))


def compare_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, only_a, only_b, moved: how two range results differ; moved pairs differ in distance."""
    both = a.select("qid", "vec_id", F.col("distance").alias("x")).join(b.select("qid", "vec_id", F.col("distance").alias("y")), ["qid", "vec_id"], "full")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return both.groupBy("qid").agg(count(F.col("y").isNull()).alias("only_a"), count(F.col("x").isNull()).alias("only_b"), count(F.col("x") != F.col("y")).alias("moved"))


def weighted_range_recall(results: DataFrame, truth: DataFrame, steps: list[tuple[float, float]]) -> DataFrame:
    """One row: recall of a range search in which a pair counts by its distance. steps: (distance up to
    which, weight), ascending; beyond the last a pair weighs nothing."""
    weight = F.lit(0.0)
    for edge, w in reversed(steps):
        weight = F.when(F.col("distance") < edge, F.lit(float(w))).otherwise(weight)
    hit = results.select("qid", "vec_id", F.lit(1.0).alias("hit"))
    each = truth.join(hit, ["qid", "vec_id"], "left").select(weight.alias("w"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
    return each.agg((F.sum(F.col("w") * F.col("hit")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("weighted_recall"))


def pareto(points: DataFrame, performance: str = "performance", time: str = "time") -> DataFrame:
    """Points that no faster point matches in performance. points: a row a tuning run."""
    before = Window.orderBy(F.col(time), F.col(performance).desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(performance).over(before)
    return points.withColumn("best", best).filter(F.col("best").isNull() | (F.col(performance) > F.col("best"))).drop("best")


def run_log_summary(log: DataFrame) -> DataFrame:
    """By dataset and rules: the least nprobe that reaches recall 1, and the mean shares skipped."""
    return log.groupBy("dataset", "opt_level").agg(F.min(F.when(F.col("recall") >= 1, F.col("nprobe"))).alias("min_nprobe"), F.max("nprobe").alias("max_nprobe"), F.avg("tri").alias("tri"), F.avg("tri_large").alias("tri_large"))

"""python -m tessera.plans.cli: build, search and measure an inverted-file index of vector files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import flat
from tessera.operators.ivf import OPT_LEVELS, IvfIndex, find_saved, opt_level
from tessera.operators.kmeans import KMeansParams
from tessera.plans.tuning import sweep
from tessera.sources import results, vecs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--benchmarks_path", default="./benchmarks")
    p.add_argument("--dataset", default="HandOutlines")
    p.add_argument("--input_format", default="fvecs", choices=["fvecs", "bvecs", "parquet"])
    p.add_argument("--output_format", default="bin", choices=["bin", "txt"], help="bin: Parquet")
    p.add_argument("--k", type=int, default=100)
    p.add_argument("--subk", type=int, default=15)
    p.add_argument("--nq", type=int, default=0, help="queries to take; 0: all")
    p.add_argument("--nprobes", type=int, nargs="+", default=[0], help="0 as the last: all lists")
    p.add_argument("--opt_levels", nargs="+", default=list(OPT_LEVELS))
    p.add_argument("--train_only", action="store_true")
    p.add_argument("--cache", action="store_true")
    p.add_argument("--sub_nprobe_ratio", type=float, default=1.0)
    p.add_argument("--metric", type=str.lower, default="l2", choices=["l2", "ip"])
    p.add_argument("--baseline", action="store_true", help="also the unpruned search")
    p.add_argument("--loop", type=int, default=1)
    p.add_argument("--nlist", type=int, default=0, help="0: square root of the number of vectors")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--ratios", type=float, nargs="+", default=[1.0])
    p.add_argument("--csv", default="")
    p.add_argument("--dataset_info", action="store_true")
    p.add_argument("--early_stop", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str]):
    """The search log (a DataFrame), or the dataset's (nb, nq, d), or None after training only."""
    o = parser().parse_args(argv)
    if o.early_stop and o.ratios != [1.0]:
        raise ValueError("an early stop is for the lossless ratio 1")
    top = f"{o.benchmarks_path}/{o.dataset}"

    def load(kind: str):
        path = f"{top}/origin/{o.dataset}_{kind}.{o.input_format}"
        return spark.read.parquet(path) if o.input_format == "parquet" else vecs.read(spark, path)

    base, queries = load("base"), load("query").withColumnRenamed("vec_id", "qid")
    nb = base.count()
    if o.dataset_info:
        d = len(base.select("embedding").first()[0])
        found = spark.createDataFrame([(nb, queries.count(), d)], "nb long, nq long, d int")
        if o.csv:
            results.append_metrics(found, o.csv)
        return found
    if o.nq:
        queries = queries.orderBy("qid").limit(o.nq)
    nlist = o.nlist or max(1, int(nb**0.5))
    opts = [*(["OPT_NONE"] if o.baseline and "OPT_NONE" not in o.opt_levels else []), *o.opt_levels]
    mask = 0
    for x in opts:
        mask |= opt_level(x)
    where = f"{top}/index/{o.metric}-{nlist}-{mask}-{o.subk}"
    index = None
    if o.cache and vecs.exists(spark, f"{top}/index"):
        saved = find_saved(spark, f"{top}/index", o.metric, mask, nlist, o.subk)
        index = IvfIndex.load(spark, saved) if saved else None
    if index is None:
        index = IvfIndex.train(base, nlist, o.metric, mask, o.subk, KMeansParams(metric=o.metric)).add(base)
        if o.cache:
            index.save(where)
            index = IvfIndex.load(spark, where)
    if o.train_only:
        return None
    truth = flat.knn(queries, base, o.k, o.metric).cache()
    log = sweep(index, queries, truth, o.k, o.nprobes, opts, o.ratios, o.dataset, o.loop, o.early_stop)
    if o.csv:
        results.append_metrics(log, o.csv)
    nprobe = min(o.nprobes[-1] or nlist, nlist)
    found = index.search(queries, o.k, nprobe, opts[-1], o.ratios[-1])
    (results.write_text if o.output_format == "txt" else results.write_parquet)(found, f"{top}/result/{o.metric}")
    return log


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    out = run(spark, sys.argv[1:])
    if out is not None:
        out.orderBy(F.lit(1)).show(1000, truncate=False)


if __name__ == "__main__":
    main()

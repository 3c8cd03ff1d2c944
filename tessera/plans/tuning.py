"""Sweeps over search parameters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import evaluate
from tessera.operators.ivf import OPT_LEVELS, IvfIndex, opt_level

LOG = "dataset string, nlist int, nprobe int, opt_level string, simi_ratio double, tri double, tri_large double, subnn_L2 double, subnn_IP double, simi_update_rate double, check_L2 double, check_IP double, time_speedup double, pruning_speedup double, query_time double, qps double, recall double, r2 double"


class RepeatTimer:
    """Times of a function run again and again, without the first `warmup` runs, until `runs` are done
    or `seconds` have passed."""

    def __init__(self, runs: int = 5, warmup: int = 1, seconds: float = float("inf")):
        self.runs, self.warmup, self.seconds, self.times = runs, warmup, seconds, []

    def run(self, f: Callable[[], object]) -> RepeatTimer:
        began = time.time()
        for i in range(self.warmup + self.runs):
            at = time.time()
            f()
            if i >= self.warmup:
                self.times.append(time.time() - at)
            if time.time() - began > self.seconds and self.times:
                break
        return self

    def mean(self) -> float:
        return sum(self.times) / len(self.times)

    def least(self) -> float:
        return min(self.times)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """What a saved index takes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def build_log(index: IvfIndex, path: str, seconds: float) -> DataFrame:
    """One row for a run log: what was saved at path, its size and how long building took."""
    spark = index.rows.sparkSession
    return spark.createDataFrame([(path, index.nlist, index.opt, stored_bytes(spark, path), float(seconds))], "path string, nlist int, opt int, bytes long, build_seconds double")


def nprobe_ladder(nlist: int) -> list[int]:
    """Powers of two below nlist."""
    return [1 << i for i in range(max(1, nlist.bit_length())) if 1 << i < max(2, nlist)]


def parameter_space(nlist: int = 0, refined: bool = False, graph: bool = False, binary_codes: int = 0) -> dict[str, list]:
    out: dict[str, list] = {}
    if nlist:
        out["nprobe"] = nprobe_ladder(nlist)
    if refined:
        out["k_factor"] = [1 << i for i in range(7)]
    if graph:
        out["ef"] = [1 << i for i in range(4, 10)]
    if binary_codes:
        out["ht"] = list(range(0, binary_codes + 1, max(1, binary_codes // 8)))
    return out


def dominated(point: dict, done: list[dict]) -> bool:
    """Whether an experiment can't help. More of any parameter costs time and doesn't lose
    performance, so those done bound it: it performs no better than one with all parameters at least
    its own, and takes no less than one with all at most its own. It is left out if another
    experiment is as good as the first bound and as fast as the second."""
    most = min((d["performance"] for d in done if all(d[k] >= point[k] for k in point)), default=1.0)
    least = max((d["time"] for d in done if all(d[k] <= point[k] for k in point)), default=0.0)
    return any(d["performance"] >= most and d["time"] <= least for d in done)


def explore(space: dict[str, list], run: Callable[[dict], tuple[float, float]], limit: int | None = None) -> list[dict]:
    """Runs the experiments that may help, cheapest first; run gives (performance, time). More than
    `limit` of them is an error."""
    done: list[dict] = []
    for values in sorted(product(*space.values())):
        point = dict(zip(space, values, strict=True))
        if not dominated(point, done):
            if limit is not None and len(done) == limit:
                raise ValueError(f"more than {limit} experiments")
            performance, took = run(point)
            done.append(point | {"performance": performance, "time": took})
    return done


def sweep(
    index: IvfIndex, queries: DataFrame, truth: DataFrame, k: int, nprobes: Iterable[int], opts: Iterable[str], ratios: Iterable[float] = (1.0,), dataset: str = "", loops: int = 1, early_stop: bool = False, n_queries: int | None = None
) -> DataFrame:
    """The search log: a row for each combination, in the columns of LOG."""
    spark: SparkSession = queries.sparkSession
    n, rows, plain = n_queries or queries.count(), [], {}
    for opt in opts:
        for ratio in ratios:
            for nprobe in nprobes:
                nprobe = min(nprobe or index.nlist, index.nlist)
                if loops > 1:
                    index.search(queries, k, nprobe, opt, ratio).count()
                began = time.time()
                for _ in range(loops):
                    found = index.search(queries, k, nprobe, opt, ratio).cache()
                    found.count()
                took = (time.time() - began) / loops
                if opt_level(opt) == 0:
                    plain[nprobe] = took
                s = index.statistics(queries, k, nprobe, opt, ratio).first()
                share = lambda x: (x or 0) / max(1, s["total"] or 1)
                q = evaluate.recall_at_k(found, truth, k, index.metric == "ip").first()
                r2 = evaluate.distance_ratio(found, truth).first()[0]
                name = opt if opt in OPT_LEVELS else next(x for x, v in OPT_LEVELS.items() if v == opt_level(opt))
                rows.append((dataset, index.nlist, nprobe, name, float(ratio), share(s["skip_tri"]), share(s["skip_tri_large"]), share(s["skip_l2"]), share(s["skip_ip"]), s["update_rate"] or 0.0, 0.0, 0.0, plain.get(nprobe, took) / took, s["pruning_speedup"] or 1.0, took, n / took, q["recall"], r2))
                found.unpersist()
                if early_stop and q["recall"] >= 1:
                    break
    return spark.createDataFrame(rows, LOG)

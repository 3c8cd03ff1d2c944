"""k-means by Lloyd steps.

A step is one map over the vectors (assignment to a bounded table of centroids and per-task sums)
and one aggregate of a row a centroid; only centroids come to the driver. The start and the training
sample are the first rows in the order of md5(seed:id), so that they don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import KERNELS, matrix, rounded, tiles
from tessera.functions.vectors import METRICS
from tessera.operators.flat import STEP

#: Training samples of so many rows at most come to the driver.
LOCAL_ROWS = 8192


@dataclass
class KMeansParams:
    niter: int = 20
    nredo: int = 1
    seed: int = 6666
    metric: str = "l2"
    #: Centroids are brought to length 1 after each step.
    spherical: bool = False
    #: Centroids are rounded to whole numbers after each step.
    integer: bool = False
    #: Centroids given at the start stay as they are.
    frozen: bool = False
    max_points: int = 256
    min_points: int = 39
    weight: str | None = None


@dataclass
class KMeansModel:
    centroids: np.ndarray
    #: objective, imbalance and splits of each iteration
    history: list[dict] = field(default_factory=list)

    def assign(self, vectors: DataFrame, k: int = 1, metric: str = "l2") -> DataFrame:
        """vec_id, rank, list_id, distance: the k nearest centroids of every vector."""
        from tessera.operators.flat import assign

        return assign(vectors, self.table(vectors.sparkSession), k, metric)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list_id int, centroid array<double>")


def shuffled_order(id_col: str = "vec_id", seed: int = 6666) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def training_sample(vectors: DataFrame, nlist: int, per_centroid: int = 256, seed: int = 6666, id_col: str = "vec_id") -> DataFrame:
    """At most per_centroid vectors a centroid."""
    return first_of(vectors, nlist * per_centroid, seed, id_col)


def first_of(vectors: DataFrame, n: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """The first n vectors in the shuffled order, without sorting n rows in one task: rows are counted
    by the first four digits of their hash, and only those of the one value at the cut are sorted."""
    order = shuffled_order(id_col, seed)
    head = F.substring(order, 1, 4)
    below = 0
    for value, count in sorted(map(tuple, vectors.groupBy(head.alias("head")).count().collect())):
        if below + count >= n:
            edge = vectors.filter(head == value).orderBy(order, id_col).limit(n - below)
            return vectors.filter(head < value).unionByName(edge)
        below += count
    return vectors


def initial(vectors: DataFrame, nlist: int, seed: int = 6666, id_col: str = "vec_id") -> DataFrame:
    """vec_id and embedding of nlist different vectors to start from."""
    return first_of(vectors, nlist, seed, id_col)


def first_vectors(vectors: DataFrame, n: int, seed: int, id_col: str = "vec_id") -> np.ndarray:
    """The vectors of first_of in the shuffled order, on the driver: a count, and one pass that takes
    a fifth more than n by their hash. n: LOCAL_ROWS at most."""
    order = shuffled_order(id_col, seed)
    total = vectors.count()
    most = 1.2 * n + 64
    few = vectors.filter(order < F.lit(f"{int(most / total * 2**32):08x}")) if total > most else vectors
    first = lambda rows: rows.orderBy(order, id_col).limit(n).select("embedding").toArrow()
    found = first(few)
    if found.num_rows < min(n, total):
        found = first(first_of(vectors, n, seed, id_col))
    return matrix(found.column(0).drop_null())


def _local_sums(x: np.ndarray, v: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, objective, sum) of each centroid's vectors x of weight v."""
    kernel, greater = KERNELS[metric], METRICS[metric][1]
    total, mass, loss = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))
    for rows in tiles(len(x)):
        y, w = x[rows], v[rows]
        d = kernel(y, c)
        # by the rounded distance, the lesser list if two are as near: as in assign
        near = rounded(d).argmax(axis=1) if greater else rounded(d).argmin(axis=1)
        np.add.at(total, near, y * w[:, None])
        mass += np.bincount(near, weights=w, minlength=len(c))
        loss += np.bincount(near, weights=w * d[np.arange(len(y)), near], minlength=len(c))
    return mass, loss, total


def _sums(vectors: DataFrame, centroids: np.ndarray, metric: str, weight: str | None) -> dict[int, tuple[float, float, np.ndarray]]:
    """list_id -> (weight, objective, sum of the vectors)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, mass, loss = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                sums = _local_sums(matrix(part.column(0)), part.column(1).to_numpy(), c, metric)
                mass, loss, total = mass + sums[0], loss + sums[1], total + sums[2]
        some = np.flatnonzero(mass)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.shape[1] * len(some) + 1, c.shape[1]), pa.int32()), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(mass[some]), pa.array(loss[some]), lists], names=["list_id", "mass", "loss", "total"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = vectors.select("embedding", w.alias("w")).dropna()
    parts = rows.mapInArrow(run, "list_id int, mass double, loss double, total array<double>")
    d = centroids.shape[1]
    summed = parts.groupBy("list_id").agg(F.sum("mass").alias("mass"), F.sum("loss").alias("loss"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(d)]).alias("total"))
    return {r["list_id"]: (r["mass"], r["loss"], np.array(r["total"])) for r in summed.collect()}


def split_empty(centroids: np.ndarray, mass: np.ndarray, seed: int = 1234) -> int:
    """Empty centroids become a slightly moved copy of a large one, drawn by size; how many did."""
    draw, splits = np.random.Generator(np.random.PCG64(seed)), 0
    for i in np.flatnonzero(mass == 0):
        chance = np.maximum(mass - 1, 0)
        if chance.sum() <= 0:
            break
        j = draw.choice(len(mass), p=chance / chance.sum())
        sway = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1 + 1 / 1024, 1 - 1 / 1024)
        centroids[i] = centroids[j] * sway
        centroids[j] = centroids[j] / sway
        mass[i] = mass[j] = mass[j] / 2
        splits += 1
    return splits


def imbalance(mass: np.ndarray) -> float:
    return float(len(mass) * (mass**2).sum() / max(mass.sum(), 1e-300) ** 2)


def _finished(c: np.ndarray, params: KMeansParams) -> np.ndarray:
    if params.spherical or params.metric == "ip":
        n = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(n == 0, 1, n)
    return np.round(c) if params.integer else c


def step(vectors: DataFrame | np.ndarray, centroids: np.ndarray, params: KMeansParams) -> tuple[np.ndarray, dict]:
    """One Lloyd step: (new centroids, statistics). An empty cluster keeps its centroid."""
    if isinstance(vectors, np.ndarray):
        mass, loss, total = _local_sums(vectors, np.ones(len(vectors)), centroids, params.metric)
        sums = {i: (mass[i], loss[i], total[i]) for i in np.flatnonzero(mass)}
    else:
        sums = _sums(vectors, centroids, params.metric, params.weight)
    new, mass = centroids.copy(), np.zeros(len(centroids))
    for i, (w, _, total) in sums.items():
        mass[i] = w
        if w > 0 and not params.frozen:
            new[i] = total / w
    stats = {"objective": sum(x[1] for x in sums.values()), "imbalance": imbalance(mass)}
    stats["splits"] = 0 if params.frozen else split_empty(new, mass.copy(), params.seed)
    return _finished(new, params), stats


def sparse_assign(entries: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, list_id, distance: the nearest centroid of sparse vectors, (vec_id, pos, value) without
    zeros, pos from 0: |x|^2 + |c|^2 - 2 x.c, the product of two sparse tables summed by pair."""
    each = centroids.select("list_id", F.posexplode("centroid").alias("pos", "c"))
    size = each.groupBy("list_id").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    own = entries.groupBy("vec_id").agg(F.sum(F.col("value") * F.col("value")).alias("xx"))
    dot = entries.join(each.filter("c <> 0"), "pos").groupBy("vec_id", "list_id").agg(F.sum(F.col("value") * F.col("c")).alias("xc"))
    d = lambda c: F.floor((F.col("xx") + c) * 1e6 + 0.5) / 1e6
    met = dot.join(own, "vec_id").join(F.broadcast(size), "list_id")
    met = met.groupBy("vec_id", "xx").agg(F.min(F.struct(d(F.col("cc") - 2 * F.col("xc")).alias("distance"), "list_id")).alias("near"), F.collect_set("list_id").alias("lists"))
    # a centroid without a common entry has the product 0; the nearest of those is the shortest
    order = size.agg(F.sort_array(F.collect_list(F.struct("cc", "list_id"))).alias("order"))
    each = own.join(met.drop("xx"), "vec_id", "left").join(F.broadcast(order), F.lit(True))  # one row: a model
    other = F.get(F.filter("order", lambda x: ~F.array_contains(F.coalesce("lists", F.array().cast("array<int>")), x["list_id"])), F.lit(0))
    other = F.when(other.isNotNull(), F.struct(d(other["cc"]).alias("distance"), other["list_id"].alias("list_id")))
    return each.select("vec_id", F.least("near", other).alias("b")).select("vec_id", F.col("b.list_id").alias("list_id"), F.col("b.distance").alias("distance"))


def resumable(vectors: DataFrame, nlist: int, path: str, params: KMeansParams | None = None, id_col: str = "vec_id") -> KMeansModel:
    """As train, one run, with the centroids of each iteration written under path: a run that was
    broken off goes on where it was."""
    from tessera.sources.vecs import exists

    params, spark = params or KMeansParams(), vectors.sparkSession
    sample = training_sample(vectors, nlist, params.max_points, params.seed, id_col)
    c, done = None, 0
    while done < params.niter and exists(spark, f"{path}/{done}/_SUCCESS"):
        done += 1
    if done:
        c = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/{done - 1}").orderBy("list_id").collect()])
    else:
        rows = initial(sample, nlist, params.seed, id_col).orderBy(shuffled_order(id_col, params.seed), id_col).select("embedding").collect()
        c = _finished(np.array([r[0] for r in rows], dtype=float), params)
    history = []
    for i in range(done, params.niter):
        c, stats = step(sample, c, params)
        KMeansModel(c).table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/{i}")
        history.append(stats)
    return KMeansModel(c, history)


def train(vectors: DataFrame, nlist: int, params: KMeansParams | None = None, start: np.ndarray | None = None, id_col: str = "vec_id") -> KMeansModel:
    """The best of nredo runs. Vectors are sampled to max_points a centroid; a sample of LOCAL_ROWS
    at most, without weights, is trained on the driver."""
    params = params or KMeansParams()
    best: KMeansModel | None = None
    for redo in range(params.nredo):
        seed = params.seed + redo
        if nlist * params.max_points <= LOCAL_ROWS and params.weight is None:
            sample = first_vectors(vectors, nlist * params.max_points, seed, id_col)
            rows = sample[:nlist]
        else:
            sample = training_sample(vectors, nlist, params.max_points, seed, id_col).cache()
            rows = [] if start is not None else [r[0] for r in initial(sample, nlist, seed, id_col).orderBy(shuffled_order(id_col, seed), id_col).select("embedding").collect()]
        if start is None:
            if len(rows) < nlist:
                raise ValueError(f"{nlist} centroids need as many vectors; there are {len(rows)}")
            c = _finished(np.array(rows, dtype=float), params)
        else:
            c = np.array(start, dtype=float)
        history = []
        for _ in range(params.niter):
            c, stats = step(sample, c, params)
            history.append(stats)
        if isinstance(sample, DataFrame):
            sample.unpersist()
        model = KMeansModel(c, history)
        sign = -1 if METRICS[params.metric][1] else 1
        if best is None or sign * history[-1]["objective"] < sign * best.history[-1]["objective"]:
            best = model
    return best


def one_dimensional(values: np.ndarray, k: int) -> np.ndarray:
    """Exact 1-D k-means of a bounded sample: divide and conquer over the monotone optimum."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(j - i, 1)
    best = cost(np.zeros(n + 1, int), np.arange(n + 1))
    cuts = []
    for _ in range(1, min(k, n)):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        stack = [(0, n, 0, n)]
        while stack:
            low, high, a, b = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(a, min(mid, b) + 1)
            total = best[i] + cost(i, np.full(len(i), mid))
            j = int(total.argmin())
            new[mid], arg[mid] = total[j], i[j]
            stack += [(low, mid - 1, a, i[j]), (mid + 1, high, i[j], b)]
        best = new
        cuts.append(arg)
    ends = [n]
    for arg in reversed(cuts):
        ends.append(int(arg[ends[-1]]))
    ends = [0, *ends[::-1]] if ends[-1] else ends[::-1]
    return np.array([x[a:b].mean() for a, b in zip(ends, ends[1:]) if b > a])


def progressive(vectors: DataFrame, nlist: int, dims: list[int], params: KMeansParams | None = None) -> KMeansModel:
    """k-means on the first dims[0] dimensions, then on more, each started from the one before."""
    model = None
    full = len(vectors.select("embedding").first()[0])
    for d in [*dims, full]:
        cut = vectors.select("vec_id", F.slice("embedding", 1, d).alias("embedding"))
        start = None if model is None else np.pad(model.centroids, ((0, 0), (0, d - model.centroids.shape[1])))
        model = train(cut, nlist, params, start)
    return model


def two_level(vectors: DataFrame, coarse: int, fine: int, params: KMeansParams | None = None) -> np.ndarray:
    """coarse x fine centroids: k-means, then k-means of each cluster's sample."""
    from tessera.operators.flat import assign

    params = params or KMeansParams()
    model = train(vectors, coarse, params)
    sample = training_sample(vectors, coarse * fine, params.max_points, params.seed)
    lists = assign(sample, model.table(vectors.sparkSession)).select("vec_id", "list_id")
    out = []
    for i in range(coarse):
        part = sample.join(lists.filter(F.col("list_id") == i), "vec_id", "left_semi")
        out.append(train(part, min(fine, max(1, part.count())), params).centroids)
    return np.concatenate(out)

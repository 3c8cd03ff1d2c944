"""Inverted-file search with lossless pruning.

The index is a table: one row a vector, with its list, its distance r to the list's centroid in the
metric's own space (Euclidean for l2, the angle for ip), and optionally its nearest and farthest
neighbours within the list. A search broadcasts a bounded block of queries with their probes, scans
each part of the index once and shuffles k results a query; no list is gathered anywhere.

Pruning, for a query at distance D from a centroid and a bound t on its k-th best distance:

* tri: |r - D| > t rules a vector out (triangle inequality);
* subnn_l2: a measured vector p rules out its stored neighbour x at distance s if d(q,p) > s + t;
* subnn_ip: all vectors within t of q lie in a cone around q - c; a measured p rules out a
  neighbour whose angle to p puts it outside of the cone.

The bound starts from radii alone (the k-th least D + r needs no vector) and tightens as a task's
own results fill. With ratio 1 results are those of the unpruned search; a smaller ratio scales the
bound and may lose results.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import CELL, CELL_DIMENSIONS, KERNELS, TILE, UNITS, Best, cells, gaps, matrix, members, rounded, runs_of_equals, tiles
from tessera.functions.vectors import METRICS
from tessera.operators import maintain
from tessera.operators.flat import BLOCK_BYTES, MANY_ROWS, RESULT, assign, pieces, query_blocks
from tessera.operators.kmeans import KMeansModel, KMeansParams, train
from tessera.operators.topk import top_k
from tessera.sources.shared import materialise

TRI, SUBNN_L2, SUBNN_IP = 1, 2, 4
#: Accepted spellings of the sets of rules.
OPT_LEVELS = {
    "OPT_NONE": 0, "OPT_TRIANGLE": TRI, "OPT_SUBNN_L2": SUBNN_L2, "OPT_SUBNN_IP": SUBNN_IP, "OPT_TRI_SUBNN_L2": TRI | SUBNN_L2,
    "OPT_TRI_SUBNN_IP": TRI | SUBNN_IP, "OPT_SUBNN_ONLY": SUBNN_L2 | SUBNN_IP, "OPT_ALL": TRI | SUBNN_L2 | SUBNN_IP,
}
#: Rows of a list that ask for their neighbours in one task, and bytes of those that they meet there.
SUB_BLOCK, SUB_BYTES = 16384, 32 << 20
#: From so many rows on, an index of few partitions is dealt to all cores.
SPREAD_ROWS = 1 << 17
#: Different vectors of a list that meet a tile of queries at once.
STEP = 4096
#: Whether a vector is a pivot: a quarter of them, equal ones alike.
PIVOT = "pmod(xxhash64(embedding), 4) = 0"
#: Those by which a search for neighbours widens at once.
WINDOW = 256
#: Rows on either side that each direction of the plane meets first, and then, if they may not do.
AROUND = (32, 128)
COUNTERS = ("total", "skip_tri", "skip_tri_large", "skip_axes", "skip_l2", "skip_ip", "skip_cells", "computed", "updates")


def opt_level(value: int | str) -> int:
    """From a name, a number or a number's text."""
    if isinstance(value, str):
        value = OPT_LEVELS[value] if value in OPT_LEVELS else int(value)
    if not 0 <= value <= 7:
        raise ValueError(f"no such set of rules: {value}")
    return value


def _space(metric: str, d: np.ndarray) -> np.ndarray:
    """A ranking distance as a distance that obeys the triangle inequality."""
    return np.arccos(np.clip(d, -1, 1)) if metric == "ip" else np.sqrt(np.maximum(d, 0))


_SLACK = {"l2": 1e-6, "ip": 2e-6}


def _within(metric: str, key: np.ndarray) -> np.ndarray:
    """The distance in the metric's own space of the k-th best, and of all that rounds to it."""
    return _space(metric, key - 1 / UNITS if metric == "ip" else key + 1 / UNITS)


@dataclass(frozen=True)
class IvfIndex:
    centroids: np.ndarray
    rows: DataFrame | None = None
    metric: str = "l2"
    opt: int = TRI
    sub_k: int = 15
    nprobe: int = 1
    extra: dict = field(default_factory=dict)

    # --- building -------------------------------------------------------------------------

    @staticmethod
    def train(vectors: DataFrame, nlist: int, metric: str = "l2", opt: int | str = TRI, sub_k: int = 15, params: KMeansParams | None = None, **more) -> IvfIndex:
        opt = opt_level(opt)
        if metric not in ("l2", "ip") or metric == "ip" and opt & ~TRI:
            raise ValueError("metric l2 takes every rule, ip (of unit vectors) only tri, and there is no other")
        model = train(vectors, nlist, params or KMeansParams(metric=metric))
        return IvfIndex(model.centroids, None, metric, opt, sub_k, **more)

    @staticmethod
    def from_centroids(centroids: np.ndarray, metric: str = "l2", opt: int | str = TRI, sub_k: int = 15, **more) -> IvfIndex:
        return IvfIndex(np.asarray(centroids, dtype=float), None, metric, opt_level(opt), sub_k, **more)

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def centroid_table(self, spark: SparkSession) -> DataFrame:
        return KMeansModel(self.centroids).table(spark)

    def placed(self, vectors: DataFrame, lists: DataFrame | None = None) -> DataFrame:
        """list_id, vec_id, embedding, d2c, r; lists: (vec_id, list_id) if the caller has chosen."""
        centroids, metric = self.centroids, self.metric
        if self.centroids.nbytes > BLOCK_BYTES:
            raise ValueError("the centroids are too large to be sent to every task")
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)
        if lists is not None:
            vectors = vectors.join(lists.select("vec_id", F.col("list_id").alias("chosen")), "vec_id")
        else:
            vectors = vectors.withColumn("chosen", F.lit(None).cast("int"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    part = whole.slice(at, 4096)
                    x, own = matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                    sign = -1 if metric == "ip" else 1
                    near = np.concatenate([(sign * rounded(KERNELS[metric](x[some], c))).argmin(axis=1) for some in tiles(len(x))])
                    near = np.where(np.isnan(own.astype(float)), near, np.nan_to_num(own.astype(float))).astype(np.int32)
                    exact = np.einsum("ij,ij->i", x, c[near]) if metric == "ip" else ((x - c[near]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(near), part.column(0), part.column(1), pa.array(exact), pa.array(_space(metric, exact))], names=["list_id", "vec_id", "embedding", "d2c", "r"])

        rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "chosen").dropna(subset=["vec_id", "embedding"])
        return rows.mapInArrow(run, f"list_id int, vec_id long, embedding {_kind(vectors)}, d2c double, r double")

    def add(self, vectors: DataFrame, lists: DataFrame | None = None) -> IvfIndex:
        """An index with more vectors; neighbour tables are made over all of them. The table is
        written to the shared folder, so that searches read it and don't make it again."""
        rows = self.placed(_spread(vectors), lists)
        if self.rows is not None:
            rows = self.rows.select(rows.columns).unionByName(rows)
        out = replace(self, rows=materialise(rows))
        if self.opt & (SUBNN_L2 | SUBNN_IP):
            return replace(out, rows=materialise(out.with_neighbours(_tables(self.opt)).rows))
        return out

    def with_random_neighbours(self, seed: int = 7) -> IvfIndex:
        """As with_neighbours, but sub_k members of the same list in no order instead of the nearest:
        linear in a list's size, and the rules stay lossless, as they only use distances."""
        kind, k = _kind(self.rows), self.sub_k
        sizes = self.rows.groupBy("list_id").agg(F.ceil(F.count("*") / 4096).alias("blocks"))
        base = ["list_id", "vec_id", "embedding", "d2c", "r"]
        cut = self.rows.select(*base).join(sizes, "list_id").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
        shared = self.rows.sparkSession.sparkContext.broadcast(self.centroids)

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("vec_id")
            x, ids = matrix(table.column("embedding")), table.column("vec_id").to_numpy()
            n, centre = len(ids), shared.value[table.column("list_id")[0].as_py()]
            steps = np.random.Generator(np.random.PCG64(seed)).permutation(np.arange(1, n))[:k]
            other = (np.arange(n)[:, None] + steps[None, :]) % max(n, 1)
            left = x - centre
            norm = np.linalg.norm(left, axis=1)
            norm = np.where(norm == 0, 1, norm)
            d = np.sqrt(((x[:, None, :] - x[other]) ** 2).sum(axis=2))
            cosine = np.einsum("ij,ikj->ik", left, left[other]) / norm[:, None] / norm[other]
            cuts = pa.array(np.arange(n + 1) * len(steps), pa.int32())
            lists = lambda v: pa.ListArray.from_arrays(cuts, pa.array(v.ravel()))
            columns = [table.column(c) for c in base]
            for v in (d, cosine, cosine):
                columns += [lists(ids[other]), lists(v)]
            return pa.table(columns, names=[*base, "near_ids", "near", "cos_near_ids", "cos_near", "cos_far_ids", "cos_far"])

        pairs = ", ".join(f"{n}_ids array<long>, {n} array<double>" for n in ("near", "cos_near", "cos_far"))
        done = cut.groupBy("list_id", "block").applyInArrow(run, f"list_id int, vec_id long, embedding {kind}, d2c double, r double, {pairs}")
        return replace(self, rows=materialise(done))

    def with_neighbours(self, tables: tuple[str, ...] = ("near", "cos_near", "cos_far")) -> IvfIndex:
        """Adds to each row its sub_k neighbours within its list: `near` (by distance), `cos_near`
        and `cos_far` (by the cosine of what is left after the centroid), values and ranks by six
        decimals, ties by id. tables: those that are wanted.

        A list is cut into blocks of SUB_BLOCK rows (four times as many in few dimensions) that ask and blocks of SUB_BYTES that are met; each
        meets each, a pair of blocks a task, and the best of all are kept. Equal vectors ask in one
        block, but for those of more than a quarter of a block, and are measured once there. What a
        distance to the centroid, or an angle to an axis, rules out isn't measured (see _meet)."""
        kind, k = _kind(self.rows), self.sub_k
        most = max(1, SUB_BYTES // (8 * self.centroids.shape[1] + 24))
        few = self.centroids.shape[1] < CELL_DIMENSIONS
        block = SUB_BLOCK * (4 if few else 1)
        # a row a list
        found = self.rows.groupBy("list_id").agg(F.count("*").alias("n")).collect()
        counted = [(r["list_id"], -(-r["n"] // block), -(-r["n"] // most)) for r in found]
        sizes = F.broadcast(self.rows.sparkSession.createDataFrame(counted, "list_id int, blocks long, parts long"))
        base = ["list_id", "vec_id", "embedding", "d2c", "r"]
        most_blocks, most_parts = (max((c[i] for c in counted), default=0) for i in (1, 2))
        rows = self.rows.select(*base)
        # where few are measured, equal vectors needn't ask together
        rows = _spot(rows, SUB_BLOCK // 4) if most_blocks > 1 and not few else rows.withColumn("spot", F.xxhash64("vec_id"))
        cut = rows.join(sizes, "list_id").withColumn("block", F.pmod("spot", "blocks")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts"))
        # a row asks in the pairs (its block, each part) and is met in the pairs (each block, its part); it comes to a pair once
        turn = cut.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") + F.col("blocks") - 2)))
        asks, other = F.col("turn") < F.col("parts"), F.col("turn") - F.col("parts")
        one = F.when(asks, F.col("block")).otherwise(other + (other >= F.col("block")).cast("long"))
        two = F.when(asks, F.col("turn")).otherwise(F.col("part"))
        sent = turn.select(*base, one.alias("one"), two.alias("two"), asks.alias("asks"), (two == F.col("part")).alias("met"))
        if sum(r["n"] for r in found) >= SPREAD_ROWS:
            # a few pairs a task, so that no core waits for one that has many
            sent = sent.repartition(min(4096, sum(c[1] * c[2] for c in counted)), "list_id", "one", "two")
        shared = self.rows.sparkSession.sparkContext.broadcast(self.centroids)
        names = {n: greatest for n, greatest in (("near", False), ("cos_near", True), ("cos_far", False)) if n in tables}  # whether the greatest are wanted

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by([("vec_id", "ascending"), ("d2c", "ascending")])
            asking, other = table.filter(table.column("asks")), table.filter(table.column("met"))
            first_part, centre = table.column("two")[0].as_py() == 0, shared.value[table.column("list_id")[0].as_py()]
            ids, found = asking.column("vec_id").to_numpy(), other.column("vec_id").to_numpy()
            copy = np.arange(len(ids)) - np.searchsorted(ids, ids)  # tells rows of one id apart
            q, x = matrix(asking.column("embedding")), matrix(other.column("embedding"))
            # rows of the asking id are no neighbours; they are taken out of so many more
            more = int(np.unique(found, return_counts=True)[1].max()) if len(found) else 0
            columns = [asking.column("list_id"), asking.column("vec_id"), pa.array(copy)]
            # what belongs to the row comes once
            columns += [asking.column(c) if first_part else pa.nulls(len(ids), asking.schema.field(c).type) for c in ("embedding", "d2c", "r")]
            bests = {n: Best(0, k + more, greatest) for n, greatest in names.items()}
            asker = np.zeros(0, dtype=int)
            if len(ids) and len(found):
                order, first = runs_of_equals(q, ids)
                asker = np.empty(len(ids), dtype=int)
                asker[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
                q = q[order[first]]
                order, first = runs_of_equals(x, found)
                x, found, n = x[order[first]], found[order], np.diff(np.append(first, len(found)))
                bests = {n: Best(len(q), k + more, greatest) for n, greatest in names.items()}
                _meet(bests, q, x, centre, found, (first, n))
            for best in bests.values():
                keys, name = best.keys[asker], best.ids[asker]
                if not len(asker):
                    keys, name = np.full((len(ids), 1), np.inf), np.zeros((len(ids), 1), dtype=np.int64)
                fine = np.isfinite(keys) & (name != ids[:, None])
                fine &= np.cumsum(fine, axis=1) <= k
                cuts = pa.array(np.concatenate([[0], np.cumsum(fine.sum(axis=1))]), pa.int32())
                columns += [pa.ListArray.from_arrays(cuts, pa.array(name[fine])), pa.ListArray.from_arrays(cuts, pa.array(best.sign * keys[fine]))]
            return pa.table(columns, names=["list_id", "vec_id", "copy", "embedding", "d2c", "r", *(n + end for n in names for end in ("_ids", ""))])

        pairs = ", ".join(f"{n}_ids array<long>, {n} array<double>" for n in names)
        done = sent.groupBy("list_id", "one", "two").applyInArrow(run, f"list_id int, vec_id long, copy long, embedding {kind}, d2c double, r double, {pairs}")
        if most_parts > 1:
            whole = [F.first(c, ignorenulls=True).alias(c) for c in ("embedding", "d2c", "r")]
            kept = []
            for n, greatest in names.items():
                key = F.transform(n, lambda x: -x) if greatest else F.col(n)
                each = F.arrays_zip(key.alias("key"), F.col(f"{n}_ids").alias("id"), F.col(n).alias("value"))
                kept.append(F.slice(F.sort_array(F.flatten(F.collect_list(each))), 1, k).alias(n))
            done = done.groupBy("list_id", "vec_id", "copy").agg(*whole, *kept)
            done = done.select(*base, *[F.col(n).getField(f).alias(n + end) for n in names for f, end in (("id", "_ids"), ("value", ""))])
        return replace(self, rows=done.drop("copy"))

    # --- searching ------------------------------------------------------------------------

    def probes(self, q: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances in the metric's space), each (queries, nprobe), nearest first. For a
        block of queries; those of a large table come from coarse()."""
        sign, lists, far = -1 if self.metric == "ip" else 1, [], []
        for some in tiles(len(q)):
            exact = KERNELS[self.metric](q[some], self.centroids)
            order = np.argsort(sign * rounded(exact), axis=1, kind="stable")[:, : min(nprobe, self.nlist)]
            lists.append(order)
            far.append(_space(self.metric, np.take_along_axis(exact, order, axis=1)))
        return np.concatenate(lists), np.concatenate(far)

    def coarse(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """qid, probe_rank, list_id, distance."""
        found = assign(queries, self.centroid_table(queries.sparkSession), min(nprobe, self.nlist), self.metric, "qid")
        return found.select(F.col("vec_id").alias("qid"), F.col("rank").alias("probe_rank"), "list_id", "distance")

    def least_radii(self, k: int) -> np.ndarray:
        """(lists + 1, k): the k least radii of each list, inf where it has fewer; the last row is of
        no list. A scan of two columns of the index, and k numbers a list."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, np.ndarray] = {}
            for batch in batches:
                of, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                order = np.lexsort((r, of))
                of, r = of[order], r[order]
                for a, b in zip(*_runs(of), strict=True):
                    best[of[a]] = np.sort(np.concatenate([best.get(of[a], r[:0]), r[a : min(b, a + k)]]))[:k]
            lists = np.repeat(np.array(list(best), dtype=np.int32), [len(v) for v in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(np.concatenate([*best.values(), np.zeros(0)]))], names=["list_id", "r"])

        out = np.full((self.nlist + 1, k), np.inf)
        near = F.slice(F.sort_array(F.collect_list("r")), 1, k).alias("r")
        for one, r in self.rows.select("list_id", "r").mapInArrow(run, "list_id int, r double").groupBy("list_id").agg(near).collect():
            out[one, : len(r)] = r
        return out

    def bounds(self, lists: np.ndarray, far: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query a distance within which k vectors of its probes lie (inf if there are fewer):
        the k-th least D + r. least: least_radii(k)."""
        out = np.empty(len(lists))
        for some in tiles(len(lists)):
            each = (far[some][:, :, None] + least[lists[some]]).reshape(len(some), -1)
            out[some] = np.partition(each, least.shape[1] - 1, axis=1)[:, least.shape[1] - 1]
        # what rounds to the k-th may be before it by its id
        return _within("ip", np.cos(np.minimum(out, np.pi))) if self.metric == "ip" else _within("l2", out**2)

    def _scan(self, ids: np.ndarray, q: np.ndarray, lists: np.ndarray, far: np.ndarray, k: int, opt: int, ratio: float, counters: bool, radius: float | None, axes: int = 0, least: np.ndarray | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
        """One block of queries against the index: results, or the counters of what was skipped.

        Equal queries of the block, and equal vectors of a list that meet in a task, are measured
        once; counters count them as often as they are there. If queries are equal, results are of
        the different ones, and the second value gives each its rows."""
        metric, greater = self.metric, METRICS[self.metric][1]
        centre = self.centroids
        # queries are the same if their vectors and probes are
        _, one, same, times = np.unique(np.concatenate([q, lists], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
        q, lists, far, same = q[one], lists[one], far[one], same.ravel()
        by_cells, cuts = metric == "l2" and 0 < q.shape[1] < CELL_DIMENSIONS and radius is None and not axes, None
        if by_cells:
            order, cuts = cells(q, TILE)
            q, lists, far, times, same = q[order], lists[order], far[order], times[order], np.argsort(order)[same]
        start = self.bounds(lists, far, least) if least is not None else np.full(len(q), np.inf if radius is None else float(_space(metric, np.array(radius))))
        copied = len(q) < len(ids)
        shared = self.rows.sparkSession.sparkContext.broadcast((ids, q, lists, far, start, same, times, centre if axes else None, cuts))
        columns = ["list_id", "vec_id", "embedding", "r"]
        if opt & SUBNN_L2:
            columns += ["near_ids", "near"]
        if opt & SUBNN_IP:
            columns += ["cos_near_ids", "cos_near", "cos_far_ids", "cos_far"]
        slack, nlist = _SLACK[metric], self.nlist
        kernel = KERNELS[metric]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, lists, far, start, same, times, centre, cuts = shared.value
            asking, begin = np.argsort(same, kind="stable"), np.cumsum(times) - times
            best, count, bound = Best(len(q), k, greater), dict.fromkeys(COUNTERS, 0), start.copy()
            # the queries of each list, those it is nearest to first: their bounds serve the other lists
            turns: list[tuple[int, np.ndarray, np.ndarray]] = []
            for slots in (slice(0, 1), slice(1, None)):
                row, slot = np.nonzero(lists[:, slots] >= 0)
                slot += slots.start
                of, d_far = lists[row, slot], far[row, slot]
                order = np.lexsort((d_far, of))
                row, of, d_far = row[order], of[order], d_far[order]
                turns += [(int(of[a]), row[a:b], d_far[a:b]) for a, b in zip(*_runs(of), strict=True)]
            for piece in pieces(batches):
                if by_cells:
                    _by_cells(best, bound, list(_parts(piece, opt, True)), q, cuts, lists, far, times, nlist, opt, ratio, slack, count, counters)
                    continue
                parts = {int(part.list_id): part for part in _parts(piece, opt)}
                for of, every, distance in turns:
                    part = parts.get(of)
                    if part is None:
                        continue
                    for some in tiles(len(every)):
                        rows, d_far = every[some], distance[some]
                        reach, n = ratio * bound[rows] * (1 + slack) + slack, times[rows]
                        count["total"] += int(n.sum() * part.weight[-1])
                        low, high = np.zeros(len(rows), dtype=int), np.full(len(rows), len(part.r))
                        if opt & TRI or radius is not None:
                            low, high = np.searchsorted(part.r, d_far - reach), np.searchsorted(part.r, d_far + reach, "right")
                            count["skip_tri"] += int(n @ part.weight[low])
                            count["skip_tri_large"] += int(n @ (part.weight[-1] - part.weight[high]))
                        for step in part.steps:
                            a, b = max(step.begin, int(low.min())), min(step.end, int(high.max()))
                            if a >= b:
                                continue
                            here, free = np.arange(a, b), low.max() <= a and high.min() >= b and not (opt & ~TRI or axes)
                            allowed = np.ones((len(rows), b - a), dtype=bool)
                            if not free and (opt & TRI or radius is not None):
                                allowed = (here >= low[:, None]) & (here < high[:, None])
                            x, weight = part.x[a:b], np.diff(part.weight[a : b + 1])
                            copies = part.first[a:b], weight
                            if axes:
                                skip = axis_rule(x, q[rows], centre[of], bound[rows] * (1 + slack) + slack, axes) & allowed
                                count["skip_axes"] += int(n @ (skip @ weight))
                                allowed &= ~skip
                            if opt & (SUBNN_L2 | SUBNN_IP) and step.owners:
                                pivots = step.pivots[(step.pivots >= a) & (step.pivots < b)] - a
                                d = kernel(q[rows], x[pivots])
                                seen = allowed[:, pivots]
                                skip = _by_neighbours(step, a, b, pivots, np.sqrt(d), seen, bound[rows] * (1 + slack) + slack, ratio, d_far, part.r, n, weight, count if counters else None, allowed)
                                best.offer(rows, d, part.ids, seen, (copies[0][pivots], weight[pivots]))
                                if counters:
                                    count["computed"] += int(n @ (seen @ weight[pivots]))
                                allowed &= ~skip
                                allowed[:, pivots] = False
                            if counters:
                                count["computed"] += int(n @ (allowed @ weight))
                            left = here if free else np.flatnonzero(allowed.any(axis=0))
                            if not len(left):
                                continue
                            if len(left) < b - a:
                                x, allowed, copies = x[left], allowed[:, left], (copies[0][left], weight[left])
                            if radius is not None:
                                d = rounded(kernel(q[rows], x))
                                i, j = np.nonzero((d > radius if greater else d < radius) & allowed)
                                if not counters and len(i):
                                    # each query of these with each copy
                                    e, f = members(begin[rows[i]], times[rows[i]])
                                    g, h = members(copies[0][j][e], copies[1][j][e])
                                    yield pa.RecordBatch.from_arrays([pa.array(ids[asking[f]][g]), pa.array(part.ids[h]), pa.array(d[i, j][e][g])], names=["qid", "vec_id", "distance"])
                                continue
                            before = best.keys[rows, -1].copy()
                            best.offer(rows, kernel(q[rows], x), part.ids, None if free else allowed, copies)
                            count["updates"] += int(n @ (best.keys[rows, -1] != before))
                        if radius is None and (opt or axes):
                            full = np.isfinite(best.keys[rows, -1])
                            worst = _within(metric, -best.keys[rows, -1] if greater else best.keys[rows, -1])
                            bound[rows] = np.where(full, np.fmin(bound[rows], worst), bound[rows])
            if counters:
                yield pa.RecordBatch.from_arrays([pa.array([count[c]], pa.int64()) for c in COUNTERS], names=list(COUNTERS))
            elif radius is None:
                at, found, d = best.rows()
                name = at if copied else ids[asking][at]
                for cut in range(0, max(len(at), 1), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v[cut : cut + (1 << 16)]) for v in (name, found, d)], names=["qid", "vec_id", "distance"])

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, same, times = (shared.value[i] for i in (0, 5, 6))
            asking, begin = np.argsort(same, kind="stable"), np.cumsum(times) - times
            for batch in batches:
                at = batch.column(0).to_numpy()
                e, f = members(begin[at], times[at])
                for cut in range(0, len(f), 1 << 16):
                    some = batch.take(pa.array(e[cut : cut + (1 << 16)]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asking[f[cut : cut + (1 << 16)]]]), *some.columns[1:]], names=batch.schema.names)

        wanted = np.unique(lists).tolist()
        rows = self.rows.select(*columns[:4], *[F.when(F.expr(PIVOT), F.col(c)).alias(c) for c in columns[4:]])
        if len(wanted) < min(self.nlist, 1000):
            rows = rows.filter(F.col("list_id").isin(wanted))
        found = rows.mapInArrow(run, ", ".join(f"{c} long" for c in COUNTERS) if counters else RESULT)
        return found, (lambda rows: rows.mapInArrow(expand, rows.schema)) if copied and radius is None and not counters else None

    def _blocks(self, queries: DataFrame, probes: DataFrame | None, nprobe: int) -> Iterator[tuple]:
        """(ids, vectors, lists, distances) of each block of queries."""
        for ids, q in query_blocks(queries, most=MANY_ROWS if probes is None else None):
            if probes is None:
                yield ids, q, *self.probes(q, nprobe)
                continue
            chosen: dict[int, list[int]] = {}
            for qid, list_id in probes.filter(F.col("qid").isin(ids.tolist())).select("qid", "list_id").collect():
                chosen.setdefault(qid, []).append(list_id)
            width = max(map(len, chosen.values()), default=1)
            lists = np.full((len(ids), width), -1)
            for i, qid in enumerate(ids.tolist()):
                lists[i, : len(chosen.get(qid, ()))] = chosen.get(qid, ())
            far = np.concatenate([np.take_along_axis(KERNELS[self.metric](q[some], self.centroids), np.maximum(lists[some], 0), axis=1) for some in tiles(len(q))])
            yield ids, q, lists, np.where(lists >= 0, _space(self.metric, far), np.inf)

    def _checked(self, opt: int | str | None) -> int:
        opt = self.opt if opt is None else opt_level(opt)
        if self.rows is None:
            raise ValueError("the index holds no vectors yet")
        if opt & ~(self.opt | TRI):
            raise ValueError(f"the index was built with rules {self.opt}, not {opt}")
        return opt

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, opt: int | str | None = None, ratio: float = 1.0, probes: DataFrame | None = None, max_codes: int = 0, axes: int = 0) -> DataFrame:
        """qid, rank, vec_id, distance. probes: (qid, list_id), if the caller has chosen. max_codes:
        the probe that reaches so many candidates is a query's last. axes: vectors are also ruled
        out by their angle to so many coordinate axes, seen from the centroid (l2)."""
        opt = self._checked(opt)
        if axes and self.metric != "l2":
            raise ValueError("the axis rule is for l2")
        if max_codes:
            probes = maintain.capped_probes(probes if probes is not None else self.coarse(queries, nprobe or self.nprobe), self.list_sizes(), max_codes)
        least = self.least_radii(k) if opt or axes else None
        found, names = [], []
        for b in self._blocks(queries, probes, nprobe or self.nprobe):
            found.append(self._scan(*b, k, opt, ratio, False, None, axes, least))
            names.append(b[0])
        greater, columns = METRICS[self.metric][1], ["qid", "rank", "vec_id", "distance"]
        if not found:
            return top_k(queries.sparkSession.createDataFrame([], RESULT), k, greater).select(*columns)
        if len(np.unique(np.concatenate(names))) == sum(map(len, names)):
            # a block's results are merged before equal queries get their rows
            done = [top_k(rows, k, greater).select(*columns) for rows, _ in found]
            n = queries.sparkSession.sparkContext.defaultParallelism
            return reduce(DataFrame.union, [rows if expand is None else expand(rows.repartition(n, "qid")) for rows, (_, expand) in zip(done, found, strict=True)])
        return top_k(reduce(DataFrame.union, [rows if expand is None else expand(rows) for rows, expand in found]), k, greater).select(*columns)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int | None = None, probes: DataFrame | None = None) -> DataFrame:
        """qid, vec_id, distance of all in the probed lists nearer than radius; tri prunes by it."""
        self._checked(0)
        found = [self._scan(*b, 1, 0, 1.0, False, radius)[0] for b in self._blocks(queries, probes, nprobe or self.nprobe)]
        return reduce(DataFrame.union, found) if found else queries.sparkSession.createDataFrame([], RESULT)

    def statistics(self, queries: DataFrame, k: int, nprobe: int | None = None, opt: int | str | None = None, ratio: float = 1.0, axes: int = 0) -> DataFrame:
        """One row: how many candidates there were, which rule skipped how many, and the speed-up."""
        opt = self._checked(opt)
        least = self.least_radii(k) if opt or axes else None
        found = reduce(DataFrame.union, [self._scan(*b, k, opt, ratio, True, None, axes, least)[0] for b in self._blocks(queries, None, nprobe or self.nprobe)])
        return found.agg(*[F.sum(c).alias(c) for c in COUNTERS]).withColumn("pruning_speedup", F.col("total") / F.nullif(F.col("computed"), F.lit(0))).withColumn("update_rate", F.col("updates") / F.nullif(F.col("computed"), F.lit(0)))

    # --- looking inside, changing ---------------------------------------------------------

    def list_sizes(self) -> DataFrame:
        return self.rows.groupBy("list_id").agg(F.count("*").alias("n"), F.max("r").alias("r_max"), F.min("r").alias("r_min"))

    def remove(self, ids: DataFrame) -> IvfIndex:
        return self._changed(self.rows.join(ids.select("vec_id"), "vec_id", "left_anti"))

    def update(self, vectors: DataFrame) -> IvfIndex:
        """Vectors of known ids are replaced, and placed anew."""
        return self.remove(vectors).add(vectors)

    def merge(self, other: IvfIndex, id_offset: int = 0) -> IvfIndex:
        if other.metric != self.metric or not np.array_equal(other.centroids, self.centroids):
            raise ValueError("indexes of different centroids can't be merged")
        plain = ["list_id", "vec_id", "embedding", "d2c", "r"]
        more = other.rows.select(plain).withColumn("vec_id", F.col("vec_id") + id_offset).select(plain)
        return self._changed(self.rows.select(plain).unionByName(more))

    def subset(self, condition) -> IvfIndex:
        """Rows that pass a condition (an id range, a remainder, a range of lists)."""
        return self._changed(self.rows.filter(condition))

    def reset(self) -> IvfIndex:
        return replace(self, rows=None)

    def subset_of(self, rows: DataFrame) -> IvfIndex:
        """An index of these rows, which were placed by its centroids."""
        return self._changed(rows)

    def _changed(self, rows: DataFrame) -> IvfIndex:
        out = replace(self, rows=rows)
        return out.with_neighbours(_tables(self.opt)) if self.opt & (SUBNN_L2 | SUBNN_IP) else out

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        return self.rows.select("vec_id", "embedding").join(ids.select("vec_id").distinct(), "vec_id")

    # --- storing --------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Rows in Parquet, sorted by list and radius, so that row groups and files can be skipped
        by list; what describes the index as JSON beside them."""
        meta = {"metric": self.metric, "opt": self.opt, "sub_k": self.sub_k, "nprobe": self.nprobe, "nlist": self.nlist, "d": int(self.centroids.shape[1]), "version": 1} | self.extra
        spark = self.rows.sparkSession
        self.rows.repartitionByRange("list_id", "r").sortWithinPartitions("list_id", "r").write.mode("overwrite").parquet(f"{path}/rows")
        self.centroid_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IvfIndex:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        c = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
        known = {x: meta.pop(x) for x in ("metric", "opt", "sub_k", "nprobe")}
        return IvfIndex(np.array([r["centroid"] for r in c]), spark.read.parquet(f"{path}/rows"), **known, extra=meta)


def find_saved(spark: SparkSession, folder: str, metric: str, opt: int | str, nlist: int, sub_k: int | None = None) -> str | None:
    """Path of an index saved under folder that serves: same metric and lists, and at least the
    rules wanted. Only descriptions are read."""
    wanted = opt_level(opt)
    found = spark.read.text(f"{folder}/*/meta").select(F.col("_metadata.file_path").alias("path"), "value").collect()
    for path, value in sorted(map(tuple, found)):
        meta = json.loads(value)
        same = (meta["metric"], meta["nlist"]) == (metric, nlist) and (sub_k is None or meta["sub_k"] == sub_k)
        if same and meta["opt"] & wanted == wanted:
            return path.rsplit("/meta/", 1)[0]
    return None


def axis_rule(x: np.ndarray, q: np.ndarray, c: np.ndarray, bound: np.ndarray, axes: int) -> np.ndarray:
    """(queries, vectors): which of a list's vectors can't lie within each query's bound.

    All within the bound lie in a cone around q - c of half angle t, so the angle of x - c to an
    axis differs from that of q - c by t at most. x and c: of the list; bound: of each query.
    """
    to_q, to_x = q - c, x - c
    far, r = np.linalg.norm(to_q, axis=1), np.linalg.norm(to_x, axis=1)
    some = far > bound
    out = np.zeros((len(q), len(x)), dtype=bool)
    if some.any():
        theta = np.arcsin(np.minimum(1.0, bound[some] / far[some])) + 1e-9
        for j in range(min(axes, x.shape[1])):
            beta = np.arccos(np.clip(to_q[some, j] / far[some], -1, 1))
            low, high = np.cos(np.minimum(np.pi, beta + theta)) - 1e-9, np.cos(np.maximum(0, beta - theta)) + 1e-9
            cosine = to_x[:, j] / np.where(r > 0, r, 1)
            out[some] |= ((cosine[None] < low[:, None]) | (cosine[None] > high[:, None])) & (r > 0)[None]
    return out


def sub_index_size(rows: int, sub_nlist: int, sub_nprobe: int, metric: str = "l2") -> tuple[int, int]:
    """(lists, probes) of an index within a list of so many rows: at most one list to eight rows, and
    half as many probes again for inner products."""
    nlist = max(1, min(sub_nlist, -(-rows // 8)))
    return nlist, min(nlist, sub_nprobe + sub_nprobe // 2 if metric == "ip" else sub_nprobe)


def _kind(vectors: DataFrame) -> str:
    return vectors.schema["embedding"].dataType.simpleString()


def _meet(bests: dict[str, Best], q: np.ndarray, x: np.ndarray, centre: np.ndarray, ids: np.ndarray, copies: tuple[np.ndarray, np.ndarray]) -> None:
    """Offers a list's vectors x to each q for the three neighbour tables, all that can be among the
    best. By the triangle inequality, distances to the centroid differ by no more than two vectors'
    distance, and angles to an axis by no more than their angle (that to -q, for cos_far)."""
    to_q, to_x = q - centre, x - centre
    far, r = np.linalg.norm(to_q, axis=1), np.linalg.norm(to_x, axis=1)
    # what the kernel's cancellation, or a rounding to six decimals, may hide
    slack = 2e-6 + 1e-7 * max(np.linalg.norm(q, axis=1).max(), np.linalg.norm(x, axis=1).max())
    if "near" in bests and q.shape[1] < CELL_DIMENSIONS:
        best, (turn, cuts), (order, begin) = bests["near"], cells(q, TILE), cells(x, CELL)
        best.scan_cells(q[turn], cuts, x[order], begin, ids, lambda a, b: np.sqrt(KERNELS["l2"](a, b)), tuple(c[order] for c in copies), turn, lambda rows: best.keys[rows, -1] + slack)
    elif "near" in bests:
        order = np.argsort(r, kind="stable")
        y = x[order]
        _nearest_first(bests["near"], far, r[order], lambda some, at: np.sqrt(KERNELS["l2"](q[some], y[at])), lambda worst: worst + slack, ids, tuple(c[order] for c in copies))
    if not bests.keys() & {"cos_near", "cos_far"}:
        return
    to_q /= np.where(far == 0, 1, far)[:, None]
    to_x /= np.where(r == 0, 1, r)[:, None]
    axis = int(to_x.var(axis=0).argmax())
    of_q, of_x = (np.arccos(np.clip(z[:, axis], -1, 1)) for z in (to_q, to_x))
    # the centroid has no angle: it meets, and is met by, all
    of_q[far == 0] = np.nan
    order = np.argsort(np.where(r == 0, -1, of_x), kind="stable")
    none, copies = int((r == 0).sum()), tuple(c[order] for c in copies)
    z = to_x[order]
    for name, place in (("cos_near", of_q), ("cos_far", np.pi - of_q)):
        if name not in bests:
            continue
        for some in tiles(len(q)) if none else ():
            bests[name].offer(some, to_q[some] @ z[:none].T, ids, None, tuple(c[:none] for c in copies))
        left = np.arange(len(q))
        if q.shape[1] == 2 and copies[1].sum() <= 2 * len(z):
            left = _in_the_plane(bests[name], to_q, z[none:], ids, tuple(c[none:] for c in copies))
        _nearest_first(bests[name], place, of_x[order][none:], lambda some, at: to_q[some] @ z[none:][at].T, lambda worst: np.arccos(np.clip(-worst - 2e-6, -1, 1)) + 1e-7, ids, tuple(c[none:] for c in copies), left)


def _in_the_plane(best: Best, q: np.ndarray, z: np.ndarray, ids: np.ndarray, copies: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Directions z of the plane, for directions q, by cosine: each q meets the rows next to it (or, where
    the least cosines are wanted, to -q) on the circle, and keeps the best if all others lie beyond
    the k-th best. Returns the numbers of those q that met too few; they are offered nothing."""
    sign = -best.sign
    each, row = members(*copies)
    angles = np.arctan2(z[each, 1], z[each, 0])
    order = np.argsort(angles, kind="stable")[: np.count_nonzero(~np.isnan(angles))]
    angles, z, names, n = angles[order], z[each[order]], ids[row[order]], len(order)
    angle = np.arctan2(sign * q[:, 1], sign * q[:, 0])
    some = np.isfinite(angle) & (q != 0).any(axis=1)
    rest, left = np.flatnonzero(~some), np.flatnonzero(some)
    left = left[np.argsort(angle[left], kind="stable")]
    for wide in AROUND:
        if 2 * wide >= n:
            break
        few, step = [rest[:0]], max(1, (1 << 17) // wide)
        for a in range(0, len(left), step):
            rows = left[a : a + step]
            at = (np.searchsorted(angles, angle[rows])[:, None] + np.arange(-wide, wide)) % n
            keys = rounded(best.sign * (q[rows, :1] * z[at, 0] + q[rows, 1:] * z[at, 1]))
            keys, found = np.concatenate([best.keys[rows], keys], axis=1), np.concatenate([best.ids[rows], names[at]], axis=1)
            first = np.lexsort((found, keys), axis=1)[:, : best.k]
            keys, found = np.take_along_axis(keys, first, axis=1), np.take_along_axis(found, first, axis=1)
            # what rounds to the k-th may be before it by its id
            reach = np.arccos(np.clip(-keys[:, -1] - 0.6 / UNITS, -1, 1)) + 1e-7
            ends = (angle[rows] - angles[at[:, 0]]) % (2 * np.pi), (angles[at[:, -1]] - angle[rows]) % (2 * np.pi)
            fine = np.minimum(*ends) > reach
            best.keys[rows[fine]], best.ids[rows[fine]] = keys[fine], found[fine]
            few.append(rows[~fine])
        left = np.concatenate(few)
    return np.concatenate([rest, left])


def _nearest_first(best: Best, place: np.ndarray, places: np.ndarray, measure, reach, ids: np.ndarray, copies: tuple[np.ndarray, np.ndarray], only: np.ndarray | None = None) -> None:
    """Offers vectors, sorted by places, to the queries at place (NaN: anywhere), or only to some, from
    there outwards until none that is left lies within reach of a query's k-th best."""
    only = np.arange(len(place)) if only is None else only
    order = only[np.argsort(place[only], kind="stable")]
    for tile in tiles(len(order)):
        some = order[tile]
        at, known = place[some], ~np.isnan(place[some])
        a = b = int(np.searchsorted(places, at[len(at) // 2]))
        while True:
            worst = best.keys[some, -1]
            wide = np.where(known & np.isfinite(worst), reach(np.where(np.isfinite(worst), worst, 0)), np.inf)
            low, high = (np.searchsorted(places, edge) for edge in (np.where(known, at - wide, -np.inf).min(), np.nextafter(np.where(known, at + wide, np.inf).max(), np.inf)))
            left, right = max(int(low), a - WINDOW), min(int(high), b + WINDOW)
            if left >= a and right <= b:
                break
            for begin, end in ((left, a), (b, right)):
                if begin < end:
                    best.offer(some, measure(some, slice(begin, end)), ids, None, tuple(c[begin:end] for c in copies))
            a, b = min(a, left), max(b, right)


def _spot(rows: DataFrame, most: int) -> DataFrame:
    """rows with `spot`, a hash by which equal vectors come together, but for those that are there
    more than `most` times: their rows are dealt by id. At most rows / most vectors are broadcast."""
    many = rows.dropna(subset=["embedding"]).groupBy("embedding").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    many = many.select(F.xxhash64("embedding").alias("spot"), F.lit(True).alias("many"))
    found = rows.withColumn("spot", F.xxhash64("embedding")).join(F.broadcast(many.distinct()), "spot", "left")
    return found.withColumn("spot", F.when(F.col("many"), F.xxhash64("vec_id", "spot")).otherwise(F.col("spot"))).drop("many")


def _spread(vectors: DataFrame) -> DataFrame:
    """Vectors of fewer partitions than there are cores, dealt to all of these, since a search's tasks
    are the partitions of its index; equal vectors to one (see _spot) unless they have few dimensions."""
    n = vectors.sparkSession.sparkContext.defaultParallelism
    if vectors.rdd.getNumPartitions() >= n or vectors.count() < SPREAD_ROWS:
        return vectors
    one = vectors.dropna(subset=["embedding"]).select(F.size("embedding")).first()
    if one is not None and one[0] < CELL_DIMENSIONS:
        return vectors.repartition(n, F.xxhash64("vec_id", "embedding"))
    return _spot(vectors, SUB_BLOCK // 4).repartition(n, "spot").drop("spot")


def _tables(opt: int) -> tuple[str, ...]:
    """The neighbour tables that these rules read."""
    return ("near",) * bool(opt & SUBNN_L2) + ("cos_near", "cos_far") * bool(opt & SUBNN_IP)


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return ([0, *cuts], [*cuts, len(values)]) if len(values) else ([], [])


@dataclass
class _Step:
    """Some of a part's different vectors, begin .. end - 1, and what the neighbour rules need:
    pivots, and for each table (owner, value) of each vector that a pivot has there; -1: none."""

    begin: int
    end: int
    pivots: np.ndarray
    owners: dict[str, tuple[np.ndarray, np.ndarray]]


@dataclass
class _Part:
    """The rows of a list in a piece as its different vectors in the order of r, or by cells. Vector i is that of
    the rows first[i] .. of ids, of which there are weight[i + 1] - weight[i]."""

    list_id: int
    x: np.ndarray
    r: np.ndarray
    first: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    steps: list[_Step]


def _parts(piece: pa.Table, opt: int, by_cells: bool = False) -> Iterator[_Part]:
    """by_cells: the vectors of a part lie in cells instead of in the order of r, each cell a step."""
    of, ids, r = (piece.column(c).to_numpy() for c in ("list_id", "vec_id", "r"))
    x = matrix(piece.column("embedding"))
    order, starts = runs_of_equals(x, ids, (r, of))
    of, ids, radii = of[order], ids[order], r
    wanted = [c for c, rule in (("near", SUBNN_L2), ("cos_near", SUBNN_IP), ("cos_far", SUBNN_IP)) if opt & rule]
    known = piece.column(wanted[0]).is_valid().to_numpy() if wanted else None
    for a, b in zip(*_runs(of), strict=True):
        first = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        rows, names, weight = order[a:b], ids[a:b], np.append(first, b - a)
        starts_at = np.arange(0, len(first), STEP)
        if by_cells:
            turn, starts_at = cells(x[rows[first]], CELL)
            n = np.diff(weight)[turn]
            at = members(first[turn], n)[1]
            rows, names, weight = rows[at], names[at], np.append(0, np.cumsum(n))
            first = weight[:-1]
        run = np.repeat(np.arange(len(first)), np.diff(weight))
        part = _Part(of[a], x[rows[first]], radii[rows[first]], first, weight, names, [])
        is_pivot = known[rows[first]] if wanted else np.zeros(len(first), dtype=bool)
        for begin, end in zip(starts_at, np.append(starts_at[1:], len(first)), strict=True):
            pivots, owners = begin + np.flatnonzero(is_pivot[begin:end]), {}
            held = slice(weight[begin], weight[end])
            for column in wanted if len(pivots) else ():
                at = pa.array(rows[first[pivots]])
                found = _owned(piece.column(f"{column}_ids").take(at), piece.column(column).take(at), pivots, names[held], run[held], begin, is_pivot[begin:end], column == "cos_near")
                if (found[0] >= 0).any():
                    owners[column] = found
            part.steps.append(_Step(begin, end, pivots, owners))
        yield part


def _owned(lists: pa.ChunkedArray, values: pa.ChunkedArray, pivots: np.ndarray, ids: np.ndarray, run: np.ndarray, begin: int, is_pivot: np.ndarray, greatest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the vectors from begin on, pivots (is_pivot) apart: the pivot that has one as its neighbour, the
    one with the least (or greatest) value if several have; ids and run: of the rows of these vectors."""
    lists, values = lists.combine_chunks(), values.combine_chunks()
    n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    pivot, name, value = np.repeat(pivots, n), lists.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    place, after = np.searchsorted(sorted_ids, name), np.searchsorted(sorted_ids, name, "right")
    # an id of several rows doesn't tell which of them is meant
    here = np.flatnonzero(after - place == 1)
    pivot, value, to = pivot[here], value[here], run[order[place[here]]]
    fine = np.flatnonzero(~is_pivot[to - begin])
    pivot, value, to = pivot[fine], value[fine], to[fine]
    best = np.argsort(value if greatest else -value, kind="stable")
    owner, own = np.full(len(is_pivot), -1), np.zeros(len(is_pivot))
    owner[to[best] - begin], own[to[best] - begin] = pivot[best], value[best]
    return owner, own


def _by_cells(best: Best, bound, parts: list[_Part], q, cuts, lists, far, times, nlist: int, opt: int, ratio: float, slack: float, count: dict[str, int], counters: bool) -> None:
    """Offers a piece's parts to all queries, a cell of queries (of cuts) at a time: lists from the
    nearest outwards, and in each its cells, until none is left within a query's bound. bound is
    tightened. A list is held against the triangle rule once, by the bounds at its turn."""
    low, high = (np.concatenate([f.reduceat(p.x, [s.begin for s in p.steps]) for p in parts]) for f in (np.fmin, np.fmax))
    starts = np.cumsum([0, *(len(p.steps) for p in parts)])
    radii = [(p.r[o], np.append(0, np.cumsum(np.diff(p.weight)[o]))) for p in parts for o in [np.argsort(p.r, kind="stable")]] if counters else []
    kernel = KERNELS["l2"]
    for begin, end in zip(cuts, np.append(cuts[1:], len(q)), strict=True):
        tile, to = q[begin:end], np.full((end - begin, nlist + 1), np.inf)
        np.put_along_axis(to, lists[begin:end], far[begin:end], axis=1)  # -1, no list, is the last
        gap = gaps(low, high, np.fmin.reduce(tile), np.fmax.reduce(tile))
        nearest = np.minimum.reduceat(gap, starts[:-1])
        for i in np.argsort(nearest, kind="stable"):
            part = parts[i]
            some = np.flatnonzero(np.isfinite(to[:, part.list_id]))
            rows = begin + some
            if not len(rows) or not counters and nearest[i] > bound[rows].max() * (1 + slack) + slack:
                continue
            d_far, n = to[some, part.list_id], times[rows]
            reach = ratio * bound[rows] * (1 + slack) + slack
            left = 0
            if counters:
                r, weight = radii[i]
                less, more = weight[[0]], weight[[-1]]
                if opt & TRI:
                    less, more = weight[np.searchsorted(r, d_far - reach)], weight[np.searchsorted(r, d_far + reach, "right")]
                count["total"] += int(n.sum() * weight[-1])
                count["skip_tri"] += int((n * less).sum())
                count["skip_tri_large"] += int((n * (weight[-1] - more)).sum())
                left = int((n * (more - less)).sum())
            # a list of one cell is left to the other rules
            whole = len(part.steps) == 1
            for j in np.argsort(gap[starts[i] : starts[i + 1]], kind="stable"):
                edge, cell = bound[rows] * (1 + slack) + slack, starts[i] + j
                if not whole and gap[cell] > edge.max():
                    break
                near = np.arange(len(rows)) if whole else np.flatnonzero(gaps(low[cell], high[cell], q[rows], q[rows]) <= edge)
                if not len(near):
                    continue
                step, who, m = part.steps[j], rows[near], n[near]
                a, b = step.begin, step.end
                x, weight, r = part.x[a:b], np.diff(part.weight[a : b + 1]), part.r[a:b]
                copies, allowed = (part.first[a:b], weight), None
                if opt & TRI:
                    allowed = (r >= (d_far - reach)[near, None]) & (r <= (d_far + reach)[near, None])
                elif opt or counters:
                    allowed = np.ones((len(near), b - a), dtype=bool)
                if counters:
                    left -= int(m @ (allowed @ weight))
                before = best.keys[who, -1]
                if step.owners:
                    pivots = step.pivots - a
                    d, seen = kernel(q[who], x[pivots]), allowed[:, pivots]
                    skip = _by_neighbours(step, a, b, pivots, np.sqrt(d), seen, edge[near], ratio, d_far[near], part.r, m, weight, count if counters else None, allowed)
                    best.offer(who, d, part.ids, seen, (copies[0][pivots], weight[pivots]))
                    if counters:
                        count["computed"] += int(m @ (seen @ weight[pivots]))
                    allowed &= ~skip
                    allowed[:, pivots] = False
                if counters:
                    count["computed"] += int(m @ (allowed @ weight))
                if allowed is not None:
                    held = np.flatnonzero(allowed.any(axis=0))
                    x, allowed, copies = x[held], allowed[:, held], (copies[0][held], weight[held])
                if len(x):
                    best.offer(who, kernel(q[who], x), part.ids, allowed, copies)
                after = best.keys[who, -1]
                count["updates"] += int(m @ (after != before))
                bound[who] = np.where(np.isfinite(after), np.fmin(bound[who], _within("l2", after)), bound[who])
            count["skip_cells"] += left


def _by_neighbours(step: _Step, a: int, b: int, pivots, d, measured, bound, ratio, far, r, n, weight, count, allowed) -> np.ndarray:
    """Which of the vectors a .. b - 1 the pivots rule out for which queries; pivots themselves never.

    A pivot is held against the farthest of the neighbours that it owns, once for all of them.
    pivots: from a; d: distances of queries to pivots; far: of queries to the centroid; r: of vectors to it;
    count: None if nobody counts.
    """
    skip = np.zeros((len(bound), b - a), dtype=bool)
    if not len(pivots):
        return skip

    def mark(column: str, greatest: bool, counter: str, fires) -> None:
        if column not in step.owners:
            return
        owner, value = (y[a - step.begin : b - step.begin] for y in step.owners[column])
        slot = np.searchsorted(pivots, owner - a)
        owned = np.flatnonzero((owner >= a) & (owner < b))
        if not len(owned):
            return
        slot, value = slot[owned], value[owned]
        edge = np.full(len(pivots), -np.inf if greatest else np.inf)
        (np.maximum if greatest else np.minimum).at(edge, slot, value)
        out = (fires(edge) & measured & np.isfinite(edge))[:, slot]
        if count is not None:
            out &= allowed[:, owned] & ~skip[:, owned]
            count[counter] += int(n @ (out @ weight[owned]))
        skip[:, owned] |= out

    finite = np.isfinite(bound)
    t = np.where(finite, bound, 0)
    mark("near", True, "skip_l2", lambda s: (d**2 > ratio * (s + t[:, None]) ** 2) & (d > s) & finite[:, None])
    if "cos_near" in step.owners or "cos_far" in step.owners:
        reach, rp = r[step.begin : step.end].max(), r[a:b][pivots]
        with np.errstate(invalid="ignore", divide="ignore"):
            wide = reach**2 + t**2 >= far**2
            cone = np.where(wide, np.sqrt(np.maximum(far**2 - t**2, 0)) / far, (reach**2 + far**2 - t**2) / (2 * far * reach))
            turn = (rp[None, :] ** 2 + far[:, None] ** 2 - d**2) / (2 * far[:, None] * rp[None, :])
            ok = finite[:, None] & (far[:, None] > t[:, None]) & (np.abs(turn) < cone[:, None]) & (rp > 0)[None, :]
        cone, turn = np.clip(np.nan_to_num(cone), -1, 1)[:, None], np.clip(np.nan_to_num(turn), -1, 1)
        both, cross = turn * cone, np.sqrt(1 - turn**2) * np.sqrt(1 - cone**2)
        # a margin for rounding (of stored values, too), on the side that skips less
        near, away = both + cross + 1e-6, both - cross - 1e-6
        mark("cos_near", False, "skip_ip", lambda v: (v > near * (ratio if ratio < 1 else 1)) & ok)
        mark("cos_far", True, "skip_ip", lambda v: (v < away) & ok)
    return skip

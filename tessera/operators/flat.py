"""Exact search: every query against every vector.

Queries travel, vectors stay. Queries are cut into blocks of a bounded size; a block is broadcast,
each task scans its own part of the base once and keeps the k nearest of each query, and only those
are shuffled to be merged. Nothing is cross joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.kernels import CELL, CELL_DIMENSIONS, KERNELS, TILE, UNITS, Best, cells, matrix, members, rounded, runs_of_equals, tiles
from tessera.functions.vectors import METRICS
from tessera.operators.topk import top_k

#: What one block of queries may take, in bytes and in rows.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 1 << 14
#: The same where equal queries are measured once and the rest in tiles.
MANY_ROWS = 1 << 16
STEP = 8192
#: Rows of the base that a task sorts at once.
PIECE_ROWS, PIECE_BYTES = 1 << 18, 64 << 20


def query_blocks(queries: DataFrame, id_col: str = "qid", vector: str = "embedding", most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most BLOCK_BYTES and BLOCK_ROWS (or most) rows, read from the cluster a partition at a time."""
    ids, rows, size, most = [], [], 0, most or BLOCK_ROWS
    for row in queries.select(id_col, vector).dropna().toLocalIterator(prefetchPartitions=True):
        ids.append(row[0])
        rows.append(row[1])
        size += 8 * len(row[1])
        if size >= BLOCK_BYTES or len(ids) >= most:
            yield np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)


RESULT = "qid long, vec_id long, distance double"


def _result(ids: np.ndarray, at: np.ndarray, found: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(distance)], names=["qid", "vec_id", "distance"])


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], RESULT)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to at most PIECE_ROWS and about PIECE_BYTES."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if held and (rows + batch.num_rows > PIECE_ROWS or size + batch.nbytes > PIECE_BYTES):
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """qid, rank, vec_id, distance: the k nearest of each query. queries: (qid, embedding). Equal
    queries of a block, and equal vectors that a task sorts at once, are measured once."""
    greater, kernel = METRICS[metric][1], KERNELS[metric]
    parts = []
    for ids, q in query_blocks(queries, most=MANY_ROWS):
        q, same, times = np.unique(q, axis=0, return_inverse=True, return_counts=True)
        same, by_cells, cuts = same.ravel(), metric == "l2" and 0 < q.shape[1] < CELL_DIMENSIONS, None
        if by_cells:
            order, cuts = cells(q, TILE)
            q, times, same = q[order], times[order], np.argsort(order)[same]
        shared = base.sparkSession.sparkContext.broadcast((ids, q, same, times, cuts))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, by_cells=by_cells) -> Iterator[pa.RecordBatch]:
            ids, q, same, times, cuts = shared.value
            best = Best(len(q), k, greater)
            for piece in pieces(batches):
                x, names = matrix(piece.column(1)), piece.column(0).to_numpy()
                order, first = runs_of_equals(x, names)
                x, names, n = x[order[first]], names[order], np.diff(np.append(first, len(names)))
                if by_cells:
                    order, begin = cells(x, CELL)
                    best.scan_cells(q, cuts, x[order], begin, names, kernel, (first[order], n[order]))
                    continue
                for at in range(0, len(first), STEP):
                    best.scan(q, x[at : at + STEP], names, kernel, None, (first[at : at + STEP], n[at : at + STEP]))
            at, found, d = best.rows()
            each, asking = members((np.cumsum(times) - times)[at], times[at])
            for cut in range(0, max(len(each), 1), 1 << 16):
                some = each[cut : cut + (1 << 16)]
                yield _result(ids[np.argsort(same, kind="stable")], asking[cut : cut + (1 << 16)], found[some], d[some])

        parts.append(base.select(F.col(id_col).cast("long"), vector).dropna().mapInArrow(scan, RESULT))
    if not parts:
        return _empty(base).withColumn("rank", F.lit(0)).select("qid", "rank", "vec_id", "distance")
    return top_k(reduce(DataFrame.union, parts), k, greater).select("qid", "rank", "vec_id", "distance")


def range_search(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """qid, vec_id, distance of all pairs nearer than radius (strictly), or more alike than it."""
    greater, kernel = METRICS[metric][1], KERNELS[metric]
    parts = []
    for ids, q in query_blocks(queries):
        shared = base.sparkSession.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    part = whole.slice(at, STEP)
                    x, names = matrix(part.column(1)), part.column(0).to_numpy()
                    for rows in tiles(len(ids)):
                        d = rounded(kernel(q[rows], x))
                        i, j = np.nonzero(d > radius if greater else d < radius)
                        yield _result(ids, rows[i], names[j], d[i, j])

        parts.append(base.select(F.col(id_col).cast("long"), vector).dropna().mapInArrow(scan, RESULT))
    return reduce(DataFrame.union, parts) if parts else _empty(base)


def range_limits(found: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, lims: where each query's results begin when they are laid one after another."""
    counts = queries.select("qid").distinct().join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    before = Window.orderBy("qid").rowsBetween(Window.unboundedPreceding, -1)  # one row a query
    return counts.select("qid", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)).alias("lims"))


def capped_range_search(queries: DataFrame, base: DataFrame, radius: float, most: int, metric: str = "l2") -> DataFrame:
    """A range search whose radius shrinks until at most `most` results are left in all: those
    nearer than the distance of result number most + 1 (results that tie with it go)."""
    found = range_search(queries, base, radius, metric)
    greater = METRICS[metric][1]
    order = F.col("distance").desc() if greater else F.col("distance")
    edge = found.orderBy(order).limit(most + 1).agg(F.count("*").alias("n"), (F.min if greater else F.max)("distance").alias("edge"))
    within = F.col("distance") > F.col("edge") if greater else F.col("distance") < F.col("edge")
    return found.join(F.broadcast(edge), F.lit(True)).filter((F.col("n") <= most) | within).select("qid", "vec_id", "distance")


def by_listed_ids(queries: DataFrame, base: DataFrame, metric: str = "l2") -> DataFrame:
    """qid, vec_id, distance for the ids each query lists; queries: (qid, embedding, ids)."""
    wanted = queries.select("qid", F.col("embedding").alias("q"), F.explode(F.array_distinct("ids")).alias("vec_id"))
    return wanted.join(base.select("vec_id", "embedding"), "vec_id").select("qid", "vec_id", METRICS[metric][0](F.col("q"), F.col("embedding")).alias("distance"))


def knn_by_listed_ids(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    d = by_listed_ids(queries, base, metric).withColumn("distance", F.floor(F.col("distance") * 1e6 + 0.5) / 1e6)
    return top_k(d, k, METRICS[metric][1]).select("qid", "rank", "vec_id", "distance")


def indexed_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, metric: str = "l2") -> DataFrame:
    """i, j, distance for given pairs of ids: two equi-joins."""
    a = left.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    b = right.select(F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", METRICS[metric][0](F.col("a"), F.col("b")).alias("distance"))


def centroid_block(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(list numbers, centroids) of a table that fits into BLOCK_BYTES; else a ValueError."""
    rows, size = [], 0
    for row in centroids.select("list_id", "centroid").toLocalIterator():
        rows.append(row)
        size += 8 * len(row[1])
        if size > BLOCK_BYTES:
            raise ValueError(f"centroids take more than {BLOCK_BYTES} bytes")
    if not rows:
        raise ValueError("there are no centroids")
    rows.sort(key=lambda r: r[0])
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)


def assign(vectors: DataFrame, centroids: DataFrame, k: int = 1, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, rank, list_id, distance: the k nearest centroids of every vector.

    Centroids are a model of a bounded size (nlist x d, checked by query_blocks' limit); every
    vector is settled in its own row, so nothing is shuffled.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centroid_block(centroids))
    greater, kernel = METRICS[metric][1], KERNELS[metric]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        keep = min(k, len(ids))
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                best = Best(part.num_rows, keep, greater)
                best.scan(matrix(part.column(1)), c, ids, kernel)
                row, lists, d = best.rows()
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(rank.astype(np.int32)), pa.array(lists.astype(np.int32)), pa.array(d)], names=["vec_id", "rank", "list_id", "distance"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector).dropna()
    return rows.mapInArrow(settle, "vec_id long, rank int, list_id int, distance double")


def sorted_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """qid, rank, vec_id, distance over vectors of one dimension: each step of the base is sorted,
    and a query meets only its neighbours in that order."""
    parts = []
    for ids, q in query_blocks(queries):
        shared = base.sparkSession.sparkContext.broadcast((ids, q[:, 0]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(len(ids), k, False)
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    part = whole.slice(at, STEP)
                    x, names = matrix(part.column(1))[:, 0], part.column(0).to_numpy()
                    order = np.argsort(x, kind="stable")
                    x, names = x[order], names[order]
                    here = np.searchsorted(x, q)
                    for i, v in enumerate(q.tolist()):
                        # the k on each side bound the k-th distance; all within it are offered, with its ties
                        near = np.sort((x[max(0, here[i] - k) : here[i] + k] - v) ** 2)
                        edge = min(near[k - 1] if len(near) >= k else np.inf, best.keys[i, -1]) + 2 / UNITS
                        a, b = np.searchsorted(x, v - edge**0.5), np.searchsorted(x, v + edge**0.5, "right")
                        if b > a:
                            best.offer(np.array([i]), ((x[a:b] - v) ** 2)[None], names[a:b])
            yield _result(ids, *best.rows())

        parts.append(base.select(F.col("vec_id").cast("long"), "embedding").dropna().mapInArrow(scan, RESULT))
    if not parts:
        return _empty(base).withColumn("rank", F.lit(0)).select("qid", "rank", "vec_id", "distance")
    return top_k(reduce(DataFrame.union, parts), k).select("qid", "rank", "vec_id", "distance")


def pairwise(queries: DataFrame, base: DataFrame, metric: str = "l2") -> DataFrame:
    """qid, distances: a row of the distance matrix, in the order of the base's ids. The base is a
    table of a checked size (centroid_block)."""
    shared = queries.sparkSession.sparkContext.broadcast(centroid_block(base.select(F.col("vec_id").alias("list_id"), F.col("embedding").alias("centroid"))))
    kernel = KERNELS[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                part = whole.slice(at, TILE)
                d = rounded(kernel(matrix(part.column(1)), x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["qid", "distances"])

    return queries.select(F.col("qid").cast("long"), "embedding").dropna().mapInArrow(run, "qid long, distances array<double>")


def epsilon_search(queries: DataFrame, base: DataFrame, epsilon: float, least: int, most: int, metric: str = "l2") -> DataFrame:
    """All within epsilon, `most` a query at most; the `least` nearest even if they lie farther."""
    found = knn(queries, base, most, metric)
    near = F.col("distance") > epsilon if METRICS[metric][1] else F.col("distance") < epsilon
    return found.filter(near | (F.col("rank") <= least))


def nearest_documents(queries: DataFrame, base: DataFrame, n: int, metric: str = "l2") -> DataFrame:
    """qid, rank, doc_id, distance: the n nearest documents, one being as near as its nearest
    vector. base has doc_id. Each task keeps its n best documents of each query."""
    greater, kernel = METRICS[metric][1], KERNELS[metric]
    parts = []
    for ids, q in query_blocks(queries):
        shared = base.sparkSession.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            sign = -1.0 if greater else 1.0
            best: list[dict[int, float]] = [{} for _ in ids]
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    part = whole.slice(at, STEP)
                    docs = part.column(0).to_numpy()
                    order = np.argsort(docs, kind="stable")
                    names, first = np.unique(docs[order], return_index=True)
                    x = matrix(part.column(1))
                    for rows in tiles(len(q)):
                        d = np.minimum.reduceat(sign * rounded(kernel(q[rows], x))[:, order], first, axis=1)
                        for i, near in zip(rows.tolist(), d, strict=True):
                            held = best[i]
                            for j in np.argsort(near, kind="stable")[:n].tolist() if len(names) > n else range(len(names)):
                                doc = int(names[j])
                                held[doc] = min(held.get(doc, np.inf), near[j])
                            if len(held) > n:
                                best[i] = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:n])
            flat = [(ids[i], doc, sign * d) for i, held in enumerate(best) for doc, d in held.items()]
            if flat:
                a, b, c = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["qid", "vec_id", "distance"])

        parts.append(base.select(F.col("doc_id").cast("long"), "embedding").dropna().mapInArrow(scan, RESULT))
    if not parts:
        return _empty(base).select("qid", F.lit(0).alias("rank"), F.col("vec_id").alias("doc_id"), "distance")
    each = reduce(DataFrame.union, parts).groupBy("qid", "vec_id").agg((F.max if greater else F.min)("distance").alias("distance"))
    return top_k(each, n, greater).select("qid", "rank", F.col("vec_id").alias("doc_id"), "distance")


def refine(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Candidates (qid, vec_id) ranked again by their exact distance."""
    q = queries.select("qid", F.col("embedding").alias("q"))
    exact = candidates.select("qid", "vec_id").join(base.select("vec_id", "embedding"), "vec_id").join(q, "qid")
    d = METRICS[metric][0](F.col("q"), F.col("embedding"))
    return top_k(exact.select("qid", "vec_id", (F.floor(d * 1e6 + 0.5) / 1e6).alias("distance")), k, METRICS[metric][1]).select("qid", "rank", "vec_id", "distance")


def with_vectors(results: DataFrame, base: DataFrame) -> DataFrame:
    """Results with the stored vectors of what they found."""
    return results.join(base.select("vec_id", "embedding"), "vec_id")

"""Search over bit vectors: 32-bit words in arrays, Hamming distance, buckets of equal prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.kernels import Best, matrix, tiles
from tessera.operators.flat import RESULT, STEP
from tessera.operators.topk import top_k

#: Most queries, or centroids, in one broadcast.
BLOCK_ROWS = 1 << 14


def from_vectors(vectors: DataFrame, width: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and words: the signs of the vector's entries."""
    return vectors.select(id_col, V.packed_bits(V.sign_bits(F.col(vector)), width).alias("words"))


def lsh_bits(vectors: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """vec_id, bits: whether each entry reaches its threshold (0 if not given)."""
    if thresholds is None:
        return vectors.select("vec_id", V.sign_bits(F.col("embedding")).alias("bits"))
    limits = F.array(*map(F.lit, thresholds))
    return vectors.select("vec_id", F.zip_with("embedding", limits, lambda x, t: (x.cast("double") >= t).cast("int")).alias("bits"))


def _hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += np.bitwise_count(q[:, j][:, None] ^ x[:, j][None, :])
    return out


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list = []
    for row in queries.select("qid", "words").toLocalIterator():
        held.append(row)
        if len(held) == BLOCK_ROWS:
            yield np.array([r[0] for r in held]), np.array([r[1] for r in held], dtype=np.int64)
            held = []
    if held:
        yield np.array([r[0] for r in held]), np.array([r[1] for r in held], dtype=np.int64)


def knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """qid, rank, vec_id, distance (differing bits). queries: (qid, words)."""
    found = []
    for ids, q in _blocks(queries):
        shared = base.sparkSession.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(len(ids), k, False)
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    part = whole.slice(at, STEP)
                    best.scan(q, matrix(part.column(1)).astype(np.int64), part.column(0).to_numpy(), _hamming)
            row, names, d = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(names), pa.array(d)], names=["qid", "vec_id", "distance"])

        found.append(base.select("vec_id", "words").mapInArrow(scan, RESULT))
    return top_k(reduce(DataFrame.union, found), k).select("qid", "rank", "vec_id", F.col("distance").cast("long").alias("distance"))


def range_search(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """qid, vec_id, distance of all with fewer than radius differing bits."""
    found = []
    for ids, q in _blocks(queries):
        shared = base.sparkSession.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    part = whole.slice(at, STEP)
                    x, names = matrix(part.column(1)).astype(np.int64), part.column(0).to_numpy()
                    for rows in tiles(len(ids)):
                        d = _hamming(q[rows], x)
                        i, j = np.nonzero(d < radius)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[i]]), pa.array(names[j]), pa.array(d[i, j])], names=["qid", "vec_id", "distance"])

        found.append(base.select("vec_id", "words").mapInArrow(scan, RESULT))
    return reduce(DataFrame.union, found).select("qid", "vec_id", F.col("distance").cast("long").alias("distance"))


def match_counts(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """qid, n: how many lie under radius."""
    return range_search(queries, base, radius).groupBy("qid").agg(F.count("*").alias("n"))


def _masked_knn(queries: DataFrame, base: DataFrame, k: int, columns: list[str], allowed) -> DataFrame:
    """The k nearest among the pairs that `allowed` lets through: from a tile's place in its block
    of queries and a part of the base to a boolean matrix. Queries travel, so no key is hot."""
    found = []
    for ids, q in _blocks(queries):
        mask = allowed(ids, q)
        shared = base.sparkSession.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, mask=mask) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(len(ids), k, False)
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    part = whole.slice(at, STEP)
                    x, names = matrix(part.column(1)).astype(np.int64), part.column(0).to_numpy()
                    for rows in tiles(len(ids)):
                        ok = mask(rows, x, part)
                        some = np.flatnonzero(ok.any(axis=0))
                        if len(some):
                            best.offer(rows, _hamming(q[rows], x[some]), names[some], ok[:, some])
            row, names, d = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(names), pa.array(d)], names=["qid", "vec_id", "distance"])

        found.append(base.select("vec_id", "words", *columns).mapInArrow(scan, RESULT))
    return top_k(reduce(DataFrame.union, found), k).select("qid", "rank", "vec_id", F.col("distance").cast("long").alias("distance"))


def hashed_search(queries: DataFrame, base: DataFrame, k: int, bits: int, flips: int = 0, tables: int = 1) -> DataFrame:
    """Only vectors that share one of `tables` keys of `bits` bits with the query, up to `flips`
    bits apart, count."""
    if bits * tables > 32:
        raise ValueError("keys come from the first word")
    low = (1 << bits) - 1

    def allowed(ids: np.ndarray, q: np.ndarray):
        def mask(rows: np.ndarray, x: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(rows), len(x)), dtype=bool)
            for t in range(tables):
                a, b = (q[rows, 0] >> (t * bits)) & low, (x[:, 0] >> (t * bits)) & low
                out |= np.bitwise_count(a[:, None] ^ b[None, :]) <= flips
            return out

        return mask

    return _masked_knn(queries, base, k, [], allowed)


def assign(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, words, list_id: the nearest of a small table of bit centroids (list_id, words), ties
    to the lesser list."""
    rows = sorted((r["list_id"], r["words"]) for r in centroids.select("list_id", "words").limit(BLOCK_ROWS + 1).collect())
    if len(rows) > BLOCK_ROWS:
        raise ValueError(f"more than {BLOCK_ROWS} centroids aren't sent to every task")
    shared = base.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int32), np.array([r[1] for r in rows], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                x = matrix(part.column(1)).astype(np.int64)
                near = np.concatenate([_hamming(x[rows], c).argmin(axis=1) for rows in tiles(len(x))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists[near])], names=["vec_id", "words", "list_id"])

    return base.select("vec_id", "words").mapInArrow(run, "vec_id long, words array<long>, list_id int")


def ivf_knn(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """qid, rank, vec_id, distance among each query's nprobe nearest lists."""
    probes = knn(queries, centroids.select(F.col("list_id").cast("long").alias("vec_id"), "words"), nprobe)

    def allowed(ids: np.ndarray, q: np.ndarray):
        place = {int(x): i for i, x in enumerate(ids)}
        lists = np.full((len(ids), nprobe), -1)
        for r in probes.filter(F.col("qid").isin(ids.tolist())).collect():
            lists[place[r["qid"]], r["rank"] - 1] = r["vec_id"]

        def mask(rows: np.ndarray, x: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            own = part.column(2).to_numpy()
            return (lists[rows][:, :, None] == own[None, None, :]).any(axis=1)

        return mask

    return _masked_knn(queries, assigned, k, ["list_id"], allowed)

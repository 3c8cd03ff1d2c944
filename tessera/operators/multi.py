"""Coarse quantizers of two halves, a null baseline, and the axis rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import KERNELS, Best, matrix
from tessera.operators.flat import STEP
from tessera.operators.topk import top_k


def multi_probe(queries: DataFrame, first: np.ndarray, second: np.ndarray, k: int) -> DataFrame:
    """qid, rank, i, j, distance: the k nearest cells of the product of two centroid tables, each
    over its half of the dimensions."""
    cut = first.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.arange(len(first) * len(second))
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                x = matrix(part.column(1))
                d = KERNELS["l2"](x[:, :cut], first)[:, :, None] + KERNELS["l2"](x[:, cut:], second)[:, None, :]
                best = Best(len(x), k, False)
                best.offer(np.arange(len(x)), d.reshape(len(x), -1), cells)
                row, cell, dist = best.rows()
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(rank.astype(np.int32)), pa.array((cell // len(second)).astype(np.int32)), pa.array((cell % len(second)).astype(np.int32)), pa.array(dist)],
                    names=["qid", "rank", "i", "j", "distance"],
                )

    return queries.select("qid", "embedding").mapInArrow(run, "qid long, rank int, i int, j int, distance double")


def random_results(queries: DataFrame, base: DataFrame, k: int, seed: int = 1234) -> DataFrame:
    """k rows a query that have nothing to do with it: the baseline any index must beat. The same k
    ids, in an order of their own for each query."""
    some = base.select("vec_id").orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(4 * k)
    each = queries.select("qid").join(F.broadcast(some))  # 4 k rows
    draw = F.pmod(F.xxhash64(F.lit(seed), "qid", "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return top_k(each.withColumn("distance", draw), k).select("qid", "rank", "vec_id", "distance")


def axis_skips(x: np.ndarray, q: np.ndarray, c: np.ndarray, bound: float, axes: int) -> np.ndarray:
    """Vectors of a list that can't lie within `bound` of q, seen from its centroid along the first
    `axes` coordinate axes.

    All within the bound lie in a cone around q - c of half angle t, and the angle of x - c to an
    axis differs from that of q - c by t at most.
    """
    to_q, to_x = q - c, x - c
    far, r = np.linalg.norm(to_q), np.linalg.norm(to_x, axis=1)
    if far <= bound:
        return np.zeros(len(x), dtype=bool)
    theta = np.arcsin(min(1.0, bound / far)) + 1e-9
    beta = np.arccos(np.clip(to_q[:axes] / far, -1, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.nan_to_num(to_x[:, :axes] / r[:, None], nan=2.0)
    low, high = np.cos(np.minimum(np.pi, beta + theta)) - 1e-9, np.cos(np.maximum(0, beta - theta)) + 1e-9
    return (((cosine < low) | (cosine > high)) & (cosine <= 1)).any(axis=1)

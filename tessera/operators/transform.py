"""Preprocessing of vectors: centring, normalising, remapping, linear maps, PCA, rotations.

Fitted maps are small matrices, fitted from one aggregate (sums and products of d x d, whatever the
number of rows) or a bounded sample, and applied a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.kernels import matrix
from tessera.operators.flat import STEP


def mapped(vectors: DataFrame, f, vector: str = "embedding") -> DataFrame:
    """vectors with f, from (n, d) to (n, d') matrices, applied to their vectors; other columns stay."""
    names = vectors.columns
    schema = ", ".join(f"`{c}` {'array<double>' if c == vector else vectors.schema[c].dataType.simpleString()}" for c in names)
    at = names.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                part = whole.slice(start, STEP)
                y = np.ascontiguousarray(f(matrix(part.column(at))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(part.columns)], names=names)

    return vectors.filter(F.col(vector).isNotNull()).mapInArrow(run, schema)


@dataclass
class Linear:
    """x -> A x + b."""

    a: np.ndarray
    b: np.ndarray | None = None

    def apply(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        a, b = self.a, self.b if self.b is not None else np.zeros(len(self.a))
        return mapped(vectors, lambda x: x @ a.T + b, vector)

    def reverse(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """The transpose's map, the inverse of an orthonormal one."""
        a, b = self.a, self.b if self.b is not None else np.zeros(len(self.a))
        return mapped(vectors, lambda y: (y - b) @ a, vector)


def rotation(d_in: int, d_out: int | None = None, seed: int = 12345) -> Linear:
    """A random orthonormal map, from the QR decomposition of a Gaussian matrix."""
    d_out = d_out or d_in
    draw = np.random.Generator(np.random.PCG64(seed)).standard_normal((max(d_in, d_out),) * 2)
    q, r = np.linalg.qr(draw)
    return Linear((q * np.sign(np.diag(r)))[:d_out, :d_in])


def moments(vectors: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance): each task sums up its rows, and the sums are added by row of the
    matrix; the driver gets a row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        if n:
            d = len(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(s), lists], names=["i", "n", "s", "p"])

    parts = vectors.select(vector).dropna().mapInArrow(run, "i long, n long, s double, p array<double>")
    first = vectors.select(vector).dropna().first()
    if first is None:
        raise ValueError("there are no vectors to take moments of")
    sums = [F.sum(F.get("p", F.lit(j))) for j in range(len(first[0]))]
    rows = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*sums).alias("p")).collect(), key=lambda r: r["i"])
    n, mean = rows[0]["n"], np.array([r["s"] for r in rows]) / rows[0]["n"]
    return n, mean, np.array([r["p"] for r in rows]) / n - np.outer(mean, mean)


def pca(vectors: DataFrame, d_out: int, whiten: float = 0.0, rotate: bool = False, bins: int = 0) -> Linear:
    """Principal components; whiten: the power of the eigenvalues that is divided out (-0.5 is full);
    bins: the components are ordered so that so many equal parts have about the same variance."""
    _, mean, cov = moments(vectors)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:d_out]
    if bins:
        if d_out % bins:
            raise ValueError(f"{d_out} components don't fall into {bins} parts")
        parts: list[list[int]] = [[] for _ in range(bins)]
        for i in order.tolist():  # the next largest goes to the part that has least and has room
            open_ = [p for p in parts if len(p) < d_out // bins]
            min(open_, key=lambda p: sum(max(values[j], 0) for j in p)).append(i)
        order = np.array([i for p in parts for i in p])
    a = axes[:, order].T * np.maximum(values[order], 1e-12)[:, None] ** whiten
    a = rotation(d_out).a @ a if rotate else a
    return Linear(a, -a @ mean)


def centred(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Less the mean of each dimension: an aggregate of one row, then a map."""
    d = len(vectors.select(vector).dropna().first()[0])
    mean = vectors.agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(d)])
    mean = mean.select(F.array(*[f"m{i}" for i in range(d)]).alias("mean"))
    return vectors.crossJoin(F.broadcast(mean)).withColumn(vector, V.subtract(F.col(vector), F.col("mean"))).drop("mean")  # one row


def normalised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn(vector, V.normalised(F.col(vector)))


def remapped(vectors: DataFrame, order: list[int], vector: str = "embedding") -> DataFrame:
    """Dimensions taken in this order; -1 is a zero."""
    return vectors.withColumn(vector, V.shuffled(F.col(vector), order))


def itq(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 123) -> Linear:
    """Rotation of the principal components that brings them near to their signs (bounded sample)."""
    mean = sample.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(sample.T))
    p = axes[:, np.argsort(values)[::-1][:bits]]
    z, r = (sample - mean) @ p, rotation(bits, seed=seed).a
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(z @ r).T @ z)
        r = (u @ vt).T
    a = (p @ r).T
    return Linear(a, -a @ mean)


def opq(sample: np.ndarray, m: int, bits: int = 8, rounds: int = 10) -> Linear:
    """Rotation under which a product quantizer of m parts loses least (bounded sample)."""
    from tessera.operators.quantize import ProductQuantizer

    r = rotation(sample.shape[1]).a
    for _ in range(rounds):
        x = sample @ r.T
        pq = ProductQuantizer.train(x, m, bits, rounds=4)
        u, _, vt = np.linalg.svd(pq.decode(pq.encode(x)).T @ sample)
        r = u @ vt
    return Linear(r)


@dataclass
class Chain:
    """Transforms applied one after another, undone in reverse."""

    steps: list = field(default_factory=list)

    def apply(self, vectors: DataFrame) -> DataFrame:
        for s in self.steps:
            vectors = s.apply(vectors) if hasattr(s, "apply") else s(vectors)
        return vectors

    def reverse(self, vectors: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            vectors = s.reverse(vectors)
        return vectors

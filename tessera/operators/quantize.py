"""Codecs and searches over codes: scalar, product, residual and row-wise quantizers, sign bits.

Codebooks are trained on a bounded sample and sent to the tasks; encoding, decoding and scanning
are maps over the vectors. A search over codes is the exact search with decoded distances: a lookup
table a query, a sum a code, k results a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import KERNELS, Best, matrix, tiles
from tessera.operators.flat import RESULT, STEP, query_blocks
from tessera.operators.topk import top_k


def lloyd(x: np.ndarray, k: int, rounds: int = 25, seed: int = 1234) -> np.ndarray:
    """k-means of a bounded sample in memory, for codebooks."""
    draw = np.random.Generator(np.random.PCG64(seed))
    k = min(k, len(x))
    c = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = KERNELS["l2"](x, c).argmin(axis=1)
        mass = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[mass > 0] = total[mass > 0] / mass[mass > 0, None]
        for i in np.flatnonzero(mass == 0):
            c[i] = x[draw.integers(len(x))]
    return c


def sample(vectors: DataFrame, n: int = 65536, vector: str = "embedding") -> np.ndarray:
    """At most n vectors, the first in the order of a hash of the id: what codebooks are fitted on."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select(vector).collect()
    return np.array([r[0] for r in rows], dtype=float)


def save(quantizer: Quantizer, spark: SparkSession, path: str) -> None:
    """The quantizer's numbers and arrays as one row of JSON in text: a model of bounded size."""
    spark.createDataFrame([(json.dumps(_plain(quantizer)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Quantizer:
    return _made(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def _plain(x):
    if isinstance(x, Quantizer):
        return {"kind": type(x).__name__, "fields": {k: _plain(v) for k, v in vars(x).items()}}
    if isinstance(x, np.ndarray):
        return {"dtype": str(x.dtype), "shape": list(x.shape), "values": x.ravel().tolist()}
    return [_plain(v) for v in x] if isinstance(x, list | tuple) else x.item() if isinstance(x, np.generic) else x


def _made(x):
    if isinstance(x, dict) and "kind" in x:
        known = {c.__name__: c for c in _kinds(Quantizer)}
        out = known[x["kind"]].__new__(known[x["kind"]])
        vars(out).update({k: _made(v) for k, v in x["fields"].items()})
        return out
    if isinstance(x, dict):
        return np.array(x["values"], dtype=x["dtype"]).reshape(x["shape"])
    return [_made(v) for v in x] if isinstance(x, list) else x


def _kinds(of: type) -> list[type]:
    return [of, *(k for c in of.__subclasses__() for k in _kinds(c))]


class Quantizer:
    """encode: (n, d) to (n, m) whole numbers; decode: back."""

    def encode(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encoded(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """vec_id, code."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    part = whole.slice(at, STEP)
                    codes = np.ascontiguousarray(self.encode(matrix(part.column(1))).astype(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["vec_id", "code"])

        return vectors.select(F.col("vec_id").cast("long"), vector).dropna().mapInArrow(run, "vec_id long, code array<int>")

    def decoded(self, codes: DataFrame) -> DataFrame:
        """vec_id, embedding."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                if part.num_rows:
                    x = np.ascontiguousarray(self.decode(matrix(part.column(1)).astype(np.int64)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["vec_id", "embedding"])

        return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return KERNELS["l2"](q, self.decode(codes))

    def search(self, queries: DataFrame, codes: DataFrame, k: int) -> DataFrame:
        """qid, rank, vec_id, distance to the decoded vectors."""
        found = []
        for ids, q in query_blocks(queries):
            shared = codes.sparkSession.sparkContext.broadcast((ids, q))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q = shared.value
                best = Best(len(ids), k, False)
                for whole in batches:
                    for at in range(0, whole.num_rows, STEP):
                        part = whole.slice(at, STEP)
                        best.scan(q, matrix(part.column(1)).astype(np.int64), part.column(0).to_numpy(), self.distances)
                row, names, d = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(names), pa.array(d)], names=["qid", "vec_id", "distance"])

            found.append(codes.select("vec_id", "code").mapInArrow(scan, RESULT))
        return top_k(reduce(DataFrame.union, found), k).select("qid", "rank", "vec_id", "distance")


@dataclass
class ScalarQuantizer(Quantizer):
    """Each dimension on 2^bits steps between its bounds; uniform: one pair of bounds for all."""

    low: np.ndarray
    high: np.ndarray
    bits: int = 8

    @staticmethod
    def train(vectors: DataFrame, bits: int = 8, uniform: bool = False, rule: str = "minmax", margin: float = 0.0) -> ScalarQuantizer:
        """Bounds from one aggregate. rule: minmax, meanstd (margin standard deviations), quantiles
        (margin cut on both sides)."""
        d = len(vectors.select("embedding").dropna().first()[0])
        x = [F.get("embedding", F.lit(i)).cast("double") for i in range(d)]
        if rule == "minmax":
            ends = [(F.min(v), F.max(v)) for v in x]
        elif rule == "meanstd":
            ends = [(F.avg(v) - margin * F.stddev_pop(v), F.avg(v) + margin * F.stddev_pop(v)) for v in x]
        else:
            ends = [(F.percentile_approx(v, margin), F.percentile_approx(v, 1 - margin)) for v in x]
        row = vectors.agg(F.array(*[a for a, _ in ends]).alias("low"), F.array(*[b for _, b in ends]).alias("high")).first()
        low, high = np.array(row["low"]), np.array(row["high"])
        if rule == "minmax" and margin:
            low, high = low - margin * (high - low), high + margin * (high - low)
        if uniform:
            low, high = np.full(d, low.min()), np.full(d, high.max())
        return ScalarQuantizer(low, high, bits)

    def encode(self, x: np.ndarray) -> np.ndarray:
        steps = (1 << self.bits) - 1
        span = np.where(self.high > self.low, self.high - self.low, 1)
        return np.clip(np.floor((x - self.low) / span * steps + 0.5), 0, steps).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes / ((1 << self.bits) - 1) * (self.high - self.low)


class HalfFloat(Quantizer):
    def encode(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float16).view(np.uint16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(np.uint16).view(np.float16).astype(float)


class Direct8(Quantizer):
    """Whole numbers from 0 to 255 as they are."""

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, 0, 255).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(float)


@dataclass
class ProductQuantizer(Quantizer):
    """The vector in m parts, each the number of its nearest codeword."""

    books: np.ndarray  # (m, 2^bits, d / m)

    @staticmethod
    def train(x: np.ndarray, m: int, bits: int = 8, rounds: int = 25) -> ProductQuantizer:
        if x.shape[1] % m:
            raise ValueError(f"{x.shape[1]} dimensions don't fall into {m} parts")
        books = [lloyd(part, 1 << bits, rounds) for part in np.split(x, m, axis=1)]
        return ProductQuantizer(np.stack(books))

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(x, len(self.books), axis=1)
        return np.stack([KERNELS["l2"](p, c).argmin(axis=1) for p, c in zip(parts, self.books, strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.books)], axis=1)

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = np.split(q, len(self.books), axis=1)
        return sum(KERNELS["l2"](p, c)[:, codes[:, i]] for i, (p, c) in enumerate(zip(parts, self.books, strict=True)))

    def searching(self, kind: str = "asymmetric", most_bits: int = 0) -> Quantizer:
        """The same codes searched otherwise: asymmetric (the query as it is), symmetric (its code),
        hamming (differing bits of the codes), generalised (differing parts), polysemous (asymmetric
        among codes of at most most_bits differing bits)."""
        return Searching(self, kind, most_bits)

    def reordered(self, rounds: int = 2000, seed: int = 5) -> ProductQuantizer:
        """The same codewords under numbers whose differing bits follow the distances between them
        (simulated annealing over swaps of two numbers), for polysemous and hamming searches."""
        return ProductQuantizer(np.stack([book[_annealed(book, rounds, seed + i)] for i, book in enumerate(self.books)]))

    def symmetric(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between codes."""
        return sum(KERNELS["l2"](c, c)[np.ix_(a[:, i], b[:, i])] for i, c in enumerate(self.books))

    def polysemous(self, q: np.ndarray, codes: np.ndarray, most_bits: int) -> np.ndarray:
        """Distances, infinite where the codes' bits differ from the query's code in more than most_bits."""
        own = self.encode(q)
        differ = sum(np.bitwise_count(own[:, i][:, None] ^ codes[:, i][None, :]) for i in range(len(self.books)))
        return np.where(differ <= most_bits, self.distances(q, codes), np.inf)


def _annealed(book: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """An order of the codewords in which near ones have numbers of few differing bits."""
    n, draw = len(book), np.random.Generator(np.random.PCG64(seed))
    d = KERNELS["l2"](book, book)
    goal = (d - d.mean()) / max(d.std(), 1e-12)
    bits = np.bitwise_count(np.arange(n)[:, None] ^ np.arange(n)[None, :]).astype(float)
    bits = (bits - bits.mean()) / max(bits.std(), 1e-12)
    # nearer pairs count more
    weight = np.exp(-np.maximum(goal, -3))
    order = np.arange(n)
    loss = lambda o, rows: (weight[o[rows]][:, o] * (goal[o[rows]][:, o] - bits[rows]) ** 2).sum()
    heat = 0.2 * loss(order, np.arange(n)) / n
    for i in range(rounds):
        a, b = draw.integers(n, size=2)
        if a == b:
            continue
        pair = np.array([a, b])
        now = loss(order, pair)
        order[pair] = order[pair[::-1]]
        change = loss(order, pair) - now
        if change > 0 and draw.random() >= np.exp(-change / (heat * 0.998**i + 1e-12)):
            order[pair] = order[pair[::-1]]
    return order


@dataclass
class Searching(Quantizer):
    """A product quantizer under another way to compare a query with codes."""

    of: ProductQuantizer
    kind: str = "asymmetric"
    most_bits: int = 0

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.of.encode(x)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.of.decode(codes)

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if self.kind == "asymmetric":
            return self.of.distances(q, codes)
        if self.kind == "symmetric":
            return self.of.symmetric(self.of.encode(q), codes)
        if self.kind == "polysemous":
            return self.of.polysemous(q, codes, self.most_bits)
        own = self.of.encode(q)
        if self.kind == "hamming":
            return sum(np.bitwise_count(own[:, i][:, None] ^ codes[:, i][None, :]) for i in range(own.shape[1])).astype(float)
        if self.kind == "generalised":
            return (own[:, None, :] != codes[None]).sum(axis=2).astype(float)
        raise ValueError(f"no such search: {self.kind}")


@dataclass
class NormCoded(Quantizer):
    """An additive quantizer with the norm of what it decodes to in a code of its own, on 2^bits
    steps: distances then take a sum of products a code and one norm, not a decoded vector."""

    of: Quantizer
    low: float
    high: float
    bits: int = 8

    @staticmethod
    def train(x: np.ndarray, of: Quantizer, bits: int = 8) -> NormCoded:
        norms = (of.decode(of.encode(x)) ** 2).sum(axis=1)
        return NormCoded(of, float(norms.min()), float(norms.max()), bits)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = self.of.encode(x)
        norms, steps = (self.of.decode(codes) ** 2).sum(axis=1), (1 << self.bits) - 1
        span = self.high - self.low if self.high > self.low else 1.0
        return np.concatenate([codes, np.clip(np.floor((norms - self.low) / span * steps + 0.5), 0, steps).astype(np.int64)[:, None]], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.of.decode(codes[:, :-1])

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        norm = self.low + codes[:, -1] / ((1 << self.bits) - 1) * (self.high - self.low)
        products = sum((q @ book.T)[:, codes[:, i]] for i, book in enumerate(self.of.books))
        return np.maximum((q**2).sum(axis=1)[:, None] + norm[None, :] - 2 * products, 0)


@dataclass
class RowwiseMinMax(Quantizer):
    """Each vector on 2^bits steps of its own range, whose ends take two more codes: their 32-bit
    patterns, or 16-bit ones with half."""

    bits: int = 8
    half: bool = False

    def encode(self, x: np.ndarray) -> np.ndarray:
        kind, whole = (np.float16, np.uint16) if self.half else (np.float32, np.uint32)
        low = x.min(axis=1).astype(kind)
        span = (x.max(axis=1) - low.astype(float)).astype(kind)
        steps, width = (1 << self.bits) - 1, np.where(span > 0, span.astype(float), 1.0)
        codes = np.clip(np.floor((x - low.astype(float)[:, None]) / width[:, None] * steps + 0.5), 0, steps).astype(np.int64)
        ends = np.stack([low.view(whole), span.view(whole)], axis=1).astype(np.int64)
        return np.concatenate([np.where(ends >= 1 << 31, ends - (1 << 32), ends), codes], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        kind, whole = (np.float16, np.uint16) if self.half else (np.float32, np.uint32)
        low, span = (np.ascontiguousarray(codes[:, i] & 0xFFFFFFFF).astype(whole).view(kind).astype(float)[:, None] for i in (0, 1))
        return low + codes[:, 2:] / ((1 << self.bits) - 1) * span


@dataclass
class ResidualQuantizer(Quantizer):
    """Codewords of what the codewords before have left, by a beam search."""

    books: np.ndarray  # (m, 2^bits, d)
    beam: int = 1

    @staticmethod
    def train(x: np.ndarray, m: int, bits: int = 8, beam: int = 1, rounds: int = 25) -> ResidualQuantizer:
        left, books = x.copy(), []
        for _ in range(m):
            books.append(lloyd(left, 1 << bits, rounds))
            left = left - books[-1][KERNELS["l2"](left, books[-1]).argmin(axis=1)]
        return ResidualQuantizer(np.stack(books), beam)

    def encode(self, x: np.ndarray) -> np.ndarray:
        left, codes = x[:, None, :], np.zeros((len(x), 1, 0), dtype=np.int64)
        for book in self.books:
            n, b, d = left.shape
            cost = KERNELS["l2"](left.reshape(-1, d), book).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, : self.beam]
            parent, word = best // len(book), best % len(book)
            left = np.take_along_axis(left, parent[:, :, None], axis=1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, np.broadcast_to(parent[:, :, None], (*parent.shape, codes.shape[2])), axis=1), word[:, :, None]], axis=2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.books))


@dataclass
class LocalSearchQuantizer(ResidualQuantizer):
    """Additive codewords improved by turns: each code in view of the others (iterated conditional modes)."""

    turns: int = 4

    @staticmethod
    def train(x: np.ndarray, m: int, bits: int = 8, turns: int = 4, rounds: int = 4) -> LocalSearchQuantizer:
        out = LocalSearchQuantizer(ResidualQuantizer.train(x, m, bits).books, turns=turns)
        for _ in range(rounds):
            codes = out.encode(x)
            k = out.books.shape[1]
            one_hot = np.zeros((len(x), m * k))
            for i in range(m):
                one_hot[np.arange(len(x)), i * k + codes[:, i]] = 1
            books = np.linalg.solve(one_hot.T @ one_hot + 1e-3 * np.eye(m * k), one_hot.T @ x)
            out.books = books.reshape(m, k, -1)
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = super().encode(x)
        for _ in range(self.turns):
            for i, book in enumerate(self.books):
                rest = x - (self.decode(codes) - book[codes[:, i]])
                codes[:, i] = KERNELS["l2"](rest, book).argmin(axis=1)
        return codes


@dataclass
class ProductAdditive(Quantizer):
    """A product of residual (or local-search) quantizers over parts of the vector."""

    parts: list

    @staticmethod
    def train(x: np.ndarray, splits: int, m: int, bits: int = 8, kind=ResidualQuantizer) -> ProductAdditive:
        return ProductAdditive([kind.train(p, m, bits) for p in np.split(x, splits, axis=1)])

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([p.encode(y) for p, y in zip(self.parts, np.split(x, len(self.parts), axis=1), strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([p.decode(c) for p, c in zip(self.parts, np.split(codes, len(self.parts), axis=1), strict=True)], axis=1)


@dataclass
class TwoLevel(Quantizer):
    """A list number and the code of the residual."""

    centroids: np.ndarray
    fine: Quantizer

    @staticmethod
    def train(x: np.ndarray, nlist: int, m: int, bits: int = 8) -> TwoLevel:
        return TwoLevel.around(x, nlist, lambda rest: ProductQuantizer.train(rest, m, bits))

    @staticmethod
    def around(x: np.ndarray, nlist: int, fit) -> TwoLevel:
        """Lists, and whatever quantizer fit makes of the residuals."""
        c = lloyd(x, nlist)
        return TwoLevel(c, fit(x - c[KERNELS["l2"](x, c).argmin(axis=1)]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        near = KERNELS["l2"](x, self.centroids).argmin(axis=1)
        return np.concatenate([near[:, None], self.fine.encode(x - self.centroids[near])], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[codes[:, 0]] + self.fine.decode(codes[:, 1:])

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not isinstance(self.fine, Searching | SpectralHash | SignBits):
            return super().distances(q, codes)
        # list by list, as these compare the query's own residual with the codes
        out = np.empty((len(q), len(codes)))
        for one in np.unique(codes[:, 0]):
            own = np.flatnonzero(codes[:, 0] == one)
            out[:, own] = self.fine.distances(q - self.centroids[one], codes[own][:, 1:])
        return out

    def search(self, queries: DataFrame, codes: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        """Only codes of each query's nprobe nearest lists count (all, if not given)."""
        if nprobe is None:
            return super().search(queries, codes, k)
        found, c = [], self.centroids
        for ids, q in query_blocks(queries):
            shared = codes.sparkSession.sparkContext.broadcast((ids, q, np.argsort(KERNELS["l2"](q, c), axis=1, kind="stable")[:, :nprobe]))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q, lists = shared.value
                best = Best(len(ids), k, False)
                for whole in batches:
                    for at in range(0, whole.num_rows, STEP):
                        part = whole.slice(at, STEP)
                        code = matrix(part.column(1)).astype(np.int64)
                        for rows in tiles(len(ids)):
                            probed = (lists[rows][:, :, None] == code[:, 0]).any(axis=1)
                            best.offer(rows, self.distances(q[rows], code), part.column(0).to_numpy(), probed)
                row, names, d = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(names), pa.array(d)], names=["qid", "vec_id", "distance"])

            found.append(codes.select("vec_id", "code").mapInArrow(scan, RESULT))
        return top_k(reduce(DataFrame.union, found), k).select("qid", "rank", "vec_id", "distance")


def lattice_points(d: int, r2: int) -> np.ndarray:
    """All points of whole numbers at squared radius r2 in d dimensions, in lexical order: the number
    of a point is its place here, which is what a code of few bits stores."""
    points = [((), r2)]
    for i in range(d):
        most = int(r2**0.5)
        points = [((*p, v), left - v * v) for p, left in points for v in range(-most, most + 1) if v * v <= left and (i < d - 1 or v * v == left)]
    return np.array([p for p, left in points if left == 0], dtype=np.int64).reshape(-1, d)


class RankedLattice(Quantizer):
    """As Lattice, for parts of few dimensions: the code of a part is one number, the place of the
    nearest point among all of the sphere's."""

    def __init__(self, parts: int, r2: int, d: int):
        self.parts, self.points = parts, lattice_points(d // parts, r2)

    def encode(self, x: np.ndarray) -> np.ndarray:
        pieces = x.reshape(len(x) * self.parts, -1)
        near = np.concatenate([(pieces[at : at + 4096] @ self.points.T).argmax(axis=1) for at in range(0, len(pieces), 4096)]) if len(pieces) else np.zeros(0, np.int64)
        return near.reshape(len(x), self.parts)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        unit = self.points / np.linalg.norm(self.points, axis=1, keepdims=True)
        return unit[codes.ravel()].reshape(len(codes), -1)


class Lattice(Quantizer):
    """Each part of the vector as the nearest point of whole numbers on a sphere of squared radius r2.
    With longest, the part's length follows as a code of 255 steps up to it; else parts have length 1."""

    def __init__(self, parts: int, r2: int, longest: float = 0.0):
        self.parts, self.r2, self.longest = parts, r2, longest

    @staticmethod
    def train(x: np.ndarray, parts: int, r2: int) -> Lattice:
        return Lattice(parts, r2, float(np.linalg.norm(x.reshape(len(x) * parts, -1), axis=1).max()))

    def encode(self, x: np.ndarray) -> np.ndarray:
        pieces = x.reshape(len(x) * self.parts, -1)
        n = np.linalg.norm(pieces, axis=1, keepdims=True)
        goal = pieces / np.where(n == 0, 1, n) * np.sqrt(self.r2)
        point = np.zeros(goal.shape, dtype=np.int64)
        for _ in range(self.r2):
            # the step that gains most for each unit of squared radius it costs
            size = np.abs(point)
            cost = 2 * size + 1
            gain = np.where((point**2).sum(axis=1, keepdims=True) + cost <= self.r2, np.abs(goal) / cost, -1)
            at = gain.argmax(axis=1)
            ok = gain[np.arange(len(at)), at] >= 0
            point[np.flatnonzero(ok), at[ok]] += np.where(goal[np.flatnonzero(ok), at[ok]] >= 0, 1, -1)
        codes = point.reshape(len(x), -1)
        if not self.longest:
            return codes
        lengths = np.clip(np.floor(n / self.longest * 255 + 0.5), 0, 255).astype(np.int64)
        return np.concatenate([codes, lengths.reshape(len(x), self.parts)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        points, lengths = (codes[:, : -self.parts], codes[:, -self.parts :]) if self.longest else (codes, None)
        pieces = points.reshape(len(codes) * self.parts, -1)
        n = np.linalg.norm(pieces, axis=1, keepdims=True)
        unit = pieces / np.where(n == 0, 1, n)
        return (unit if lengths is None else unit * lengths.reshape(-1, 1) / 255 * self.longest).reshape(len(codes), -1)


# --- codecs that stay in expressions ------------------------------------------------------


def scalar_codes(vector: Column, low: Column, high: Column, bits: int = 8) -> Column:
    """Steps between per-dimension bounds (arrays)."""
    steps = float((1 << bits) - 1)
    zipped = F.arrays_zip(vector.alias("x"), low.alias("a"), high.alias("b"))

    def code(z: Column) -> Column:
        x, a, b = (z[k].cast("double") for k in ("x", "a", "b"))
        span = F.when(b > a, b - a).otherwise(F.lit(1.0))
        return F.least(F.greatest(F.floor((x - a) / span * steps + 0.5), F.lit(0)), F.lit(int(steps))).cast("int")

    return F.transform(zipped, code)


def rowwise_codes(vector: Column, bits: int = 8) -> Column:
    """struct(low, span, codes) of each vector's own range."""
    steps = float((1 << bits) - 1)
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    ends = F.arrays_zip(vector.alias("x"), F.array_repeat(low, F.size(vector)).alias("a"), F.array_repeat(span, F.size(vector)).alias("s"))
    codes = F.transform(ends, lambda z: F.floor((z["x"].cast("double") - z["a"]) / z["s"] * steps + 0.5).cast("int"))
    return F.struct(low.alias("low"), span.alias("span"), codes.alias("codes"))


def rowwise_decoded(code: Column, bits: int = 8) -> Column:
    steps = float((1 << bits) - 1)
    low, span, codes = (code.getField(x) for x in ("low", "span", "codes"))
    zipped = F.arrays_zip(codes.alias("c"), F.array_repeat(low, F.size(codes)).alias("a"), F.array_repeat(span, F.size(codes)).alias("s"))
    return F.transform(zipped, lambda z: z["a"] + z["c"] / steps * z["s"])


@dataclass
class Refined(Quantizer):
    """Codes, and codes of what they leave."""

    coarse: Quantizer
    fine: Quantizer
    width: int

    @staticmethod
    def train(x: np.ndarray, coarse: Quantizer, m: int, bits: int = 8) -> Refined:
        codes = coarse.encode(x)
        return Refined(coarse, ProductQuantizer.train(x - coarse.decode(codes), m, bits), codes.shape[1])

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = self.coarse.encode(x)
        return np.concatenate([codes, self.fine.encode(x - self.coarse.decode(codes))], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.coarse.decode(codes[:, : self.width]) + self.fine.decode(codes[:, self.width :])


@dataclass
class SpectralHash(Quantizer):
    """Bits of which half-period of each rotated component a vector lies in."""

    axes: np.ndarray
    centre: np.ndarray
    period: float

    @staticmethod
    def train(x: np.ndarray, bits: int, period: float) -> SpectralHash:
        _, axes = np.linalg.eigh(np.cov(x.T))
        axes = axes[:, ::-1][:, :bits]
        return SpectralHash(axes, np.median(x @ axes, axis=0), period)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.floor((x @ self.axes - self.centre) / self.period).astype(np.int64) & 1

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The middle of each half-period, on the axes."""
        return (self.centre + (codes + 0.5) * self.period) @ self.axes.T

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (self.encode(q)[:, None, :] != codes[None]).sum(axis=2).astype(float)


class SignBits(Quantizer):
    """Signs of the entries less thresholds (medians, if trained); distances are differing bits."""

    def __init__(self, thresholds: np.ndarray):
        self.thresholds = thresholds

    @staticmethod
    def train(x: np.ndarray, medians: bool = False) -> SignBits:
        return SignBits(np.median(x, axis=0) if medians else np.zeros(x.shape[1]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x >= self.thresholds).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return 2.0 * codes - 1

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        own = self.encode(q)
        return (own @ (1 - codes).T + (1 - own) @ codes.T).astype(float)


@dataclass
class IndependentLists(Quantizer):
    """Lists chosen in one space (a linear map of the vectors), codes kept in another."""

    a: np.ndarray
    centroids: np.ndarray
    code: Quantizer

    @staticmethod
    def train(x: np.ndarray, a: np.ndarray, nlist: int, m: int, bits: int = 8) -> IndependentLists:
        return IndependentLists(a, lloyd(x @ a.T, nlist), ProductQuantizer.train(x, m, bits))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([KERNELS["l2"](x @ self.a.T, self.centroids).argmin(axis=1)[:, None], self.code.encode(x)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.code.decode(codes[:, 1:])

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.code.distances(q, codes[:, 1:])

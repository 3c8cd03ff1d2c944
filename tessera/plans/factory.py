"""Indexes from a description such as "PCA16,IVF64,Flat" or "OPQ8,IVF16,PQ8x6,RFlat".

    transforms   PCAn PCAWn PCARn (whitened, rotated)  RRn  L2norm  Centering  Padn  OPQm  ITQn
    coarse       IVFn, before any of the codes but LSH, LSHt and HNSW
    codes        Flat  SQ8 SQ6 SQ4 SQfp16  PQm PQmxb  RQmxb  LSQmxb  MinMax8  LSH  LSHt  HNSWm
    wrappers     IDMap  RFlat

Parts are separated by commas, transforms first. Codes in lists are of residuals. With
IDMap, add takes (external_id, embedding) and results carry external ids. An index is stored with
save() and read with load().
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import binary, flat, graph, quantize, transform
from tessera.operators.ivf import TRI, IvfIndex
from tessera.operators.kmeans import KMeansParams
from tessera.sources.shared import materialise


class _Step:
    """A fitted transform over DataFrames."""

    def __init__(self, apply):
        self.apply = apply


@dataclass
class Index:
    """train, then add, then search. What a description left out has its default."""

    description: str
    metric: str = "l2"
    transforms: list[tuple[str, tuple]] = field(default_factory=list)
    nlist: int = 0
    code: tuple[str, tuple] = ("Flat", ())
    rerank: int = 0
    opt: int = TRI
    nprobe: int = 1
    k_factor: int = 4
    ef: int = 64
    id_map: bool = False

    def __post_init__(self):
        self._chain, self._quantizer, self._ivf, self._base, self._stored, self._ids, self._width = [], None, None, None, None, None, 0

    def _transformed(self, vectors: DataFrame) -> DataFrame:
        for step in self._chain:
            vectors = step.apply(vectors)
        return vectors

    def train(self, vectors: DataFrame) -> Index:
        self._chain = []
        for name, args in self.transforms:
            now = self._transformed(vectors.select("vec_id", "embedding"))
            self._chain.append(_transform(name, args, now))
        now = self._transformed(vectors.select("vec_id", "embedding"))
        kind, args = self.code
        if self.nlist and kind == "Flat":
            self._ivf = IvfIndex.train(now, self.nlist, self.metric, self.opt, params=KMeansParams(metric=self.metric))
        elif kind == "LSH":
            self._width = len(now.select("embedding").first()[0])
        elif kind not in ("Flat", "HNSW"):
            self._quantizer = _quantizer(kind, args, now, self.nlist)
        return self

    def add(self, vectors: DataFrame) -> Index:
        if self.id_map:
            first = 0 if self._ids is None else self._ids.agg(F.max("vec_id") + 1).first()[0] or 0
            if "vec_id" in vectors.columns:
                vectors = vectors.withColumn("external_id", F.col("vec_id"))
            else:
                vectors = materialise(vectors.withColumn("vec_id", F.monotonically_increasing_id() + first))
            ids = vectors.select("vec_id", "external_id")
            self._ids = ids if self._ids is None else self._ids.unionByName(ids)
        self._base = vectors.select("vec_id", "embedding") if self._base is None else self._base.unionByName(vectors.select("vec_id", "embedding"))
        now, kind = self._transformed(self._base), self.code[0]
        if self._ivf is not None:
            self._stored = self._ivf.reset().add(now)
        elif kind == "HNSW":
            self._stored = graph.build(now, *self.code[1])
        elif kind == "LSH":
            self._stored = binary.from_vectors(now, self._width)
        else:
            self._stored = self._quantizer.encoded(now) if self._quantizer else now
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, rank, vec_id, distance. queries: (qid, embedding)."""
        if self._stored is None:
            raise ValueError("nothing was added")
        moved = self._transformed(queries.select(F.col("qid").alias("vec_id"), "embedding")).withColumnRenamed("vec_id", "qid")
        n = k * self.k_factor if self.rerank else k
        kind = self.code[0]
        if self._ivf is not None:
            out = self._stored.search(moved, n, self.nprobe)
        elif kind == "HNSW":
            out = graph.search(self._stored, moved, n, self.ef)
        elif kind == "LSH":
            out = binary.knn(binary.from_vectors(moved, self._width, "qid"), self._stored, n)
        elif isinstance(self._quantizer, quantize.TwoLevel):
            out = self._quantizer.search(moved, self._stored, n, self.nprobe)
        elif self._quantizer:
            out = self._quantizer.search(moved, self._stored, n)
        else:
            out = flat.knn(moved, self._stored, n, self.metric)
        out = flat.refine(out, queries, self._base, k, self.metric) if self.rerank else out
        return out.join(self._ids, "vec_id").select("qid", "rank", F.col("external_id").alias("vec_id"), "distance") if self.id_map else out

    def save(self, path: str) -> None:
        """Everything that searching needs: parameters and models as files beside the tables."""
        if self._base is None:
            raise ValueError("nothing was added")
        spark = self._base.sparkSession
        self._base.write.mode("overwrite").parquet(f"{path}/base")
        if self._ids is not None:
            self._ids.write.mode("overwrite").parquet(f"{path}/ids")
        if self._ivf is not None:
            self._stored.save(f"{path}/ivf")
        elif self._stored is not None and self.code[0] != "Flat":
            self._stored.write.mode("overwrite").parquet(f"{path}/codes")
        if self._quantizer is not None:
            quantize.save(self._quantizer, spark, f"{path}/quantizer")
        steps = [{"a": s.a.tolist(), "b": None if s.b is None else s.b.tolist()} if isinstance(s, transform.Linear) else None for s in self._chain]
        meta = {"description": self.description, "metric": self.metric, "nprobe": self.nprobe, "k_factor": self.k_factor, "ef": self.ef, "width": self._width, "steps": steps}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
        out = build(meta["description"], meta["metric"]).set(f"nprobe={meta['nprobe']},k_factor={meta['k_factor']},ef={meta['ef']}")
        out._width, out._base = meta["width"], spark.read.parquet(f"{path}/base")
        now = out._base
        for (name, args), step in zip(out.transforms, meta["steps"], strict=True):
            linear = step and transform.Linear(np.array(step["a"]), None if step["b"] is None else np.array(step["b"]))
            out._chain.append(linear or _transform(name, args, now))
            now = out._chain[-1].apply(now)
        if out.id_map:
            out._ids = spark.read.parquet(f"{path}/ids")
        kind = out.code[0]
        if out.nlist and kind == "Flat":
            out._stored = out._ivf = IvfIndex.load(spark, f"{path}/ivf")
        else:
            out._stored = now if kind == "Flat" else spark.read.parquet(f"{path}/codes")
            if kind not in ("Flat", "HNSW") and kind != "LSH":
                out._quantizer = quantize.load(spark, f"{path}/quantizer")
        return out

    def set(self, parameters: str) -> Index:
        """From text: "nprobe=16,k_factor=8"."""
        for part in filter(None, parameters.split(",")):
            name, value = part.split("=")
            if name not in ("nprobe", "k_factor", "ef", "opt"):
                raise ValueError(f"no such parameter: {name}")
            setattr(self, name, int(value))
        return self

    def code_bytes(self, d: int) -> float:
        """Bytes a vector takes in codes."""
        kind, args = self.code
        each = {"Flat": 4 * d, "HNSW": 4 * d, "LSH": d / 8, "LSHt": d / 8, "MinMax8": d + 8, "SQ8": d, "SQ6": 0.75 * d, "SQ4": d / 2, "SQfp16": 2 * d}
        return each[kind] if kind in each else args[0] * args[1] / 8


def _transform(name: str, args: tuple, now: DataFrame):
    n = args[0] if args else 0
    if name.startswith("PCA"):
        return transform.pca(now, n, -0.5 if "W" in name else 0.0, "R" in name[3:])
    if name == "RR":
        return transform.rotation(len(now.select("embedding").first()[0]), n or None)
    if name == "L2norm":
        return _Step(transform.normalised)
    if name == "Centering":
        _, mean, _ = transform.moments(now)
        return transform.Linear(np.eye(len(mean)), -mean)
    if name == "Pad":
        d = len(now.select("embedding").first()[0])
        return _Step(lambda v: transform.remapped(v, [i if i < d else -1 for i in range(n)]))
    if name == "OPQ":
        return transform.opq(quantize.sample(now, 8192), n)
    return transform.itq(quantize.sample(now, 8192), n or len(now.select("embedding").first()[0]))


def _quantizer(kind: str, args: tuple, now: DataFrame, nlist: int) -> quantize.Quantizer:
    if kind == "SQfp16" and not nlist:
        return quantize.HalfFloat()
    if kind.startswith("SQ") and not nlist:
        return quantize.ScalarQuantizer.train(now, int(kind[2:]))
    if kind == "MinMax8" and not nlist:
        return quantize.RowwiseMinMax()
    fits = {
        "PQ": quantize.ProductQuantizer.train, "RQ": quantize.ResidualQuantizer.train, "LSQ": quantize.LocalSearchQuantizer.train, "MinMax8": lambda x: quantize.RowwiseMinMax(), "SQfp16": lambda x: quantize.HalfFloat(),
        "LSH": quantize.SignBits.train, "LSHt": lambda x: quantize.SignBits.train(x, True),
    }
    fit = fits.get(kind) or (lambda x: quantize.ScalarQuantizer(x.min(axis=0), x.max(axis=0), int(kind[2:])))
    x = quantize.sample(now)
    return quantize.TwoLevel.around(x, nlist, lambda rest: fit(rest, *args)) if nlist else fit(x, *args)


def build(description: str, metric: str = "l2") -> Index:
    """The untrained index of a description."""
    out = Index(description, metric)
    done = False
    for part in description.replace(" ", "").split(","):
        number = lambda m: int(m) if m else 0
        if m := re.fullmatch(r"(PCA[WR]{0,2}|RR|Pad|OPQ|ITQ)(\d*)", part):
            out.transforms.append((m[1], (number(m[2]),)))
        elif part in ("L2norm", "Centering"):
            out.transforms.append((part, ()))
        elif part == "IDMap":
            out.id_map = True
        elif m := re.fullmatch(r"IVF(\d+)", part):
            out.nlist = int(m[1])
        elif part == "RFlat":
            out.rerank = 1
        elif part in ("Flat", "LSH", "LSHt", "MinMax8", "SQ8", "SQ6", "SQ4", "SQfp16"):
            out.code, done = (part, ()), True
        elif m := re.fullmatch(r"(PQ|RQ|LSQ)(\d+)(?:x(\d+))?", part):
            out.code, done = (m[1], (int(m[2]), int(m[3] or 8))), True
        elif m := re.fullmatch(r"HNSW(\d*)", part):
            out.code, done = ("HNSW", (number(m[1]) or 16,)), True
        else:
            raise ValueError(f"can't read {part!r} in {description!r}")
    if out.nlist and out.code[0] in ("LSH", "LSHt", "HNSW"):
        raise ValueError("lists hold vectors or codes of residuals")
    if not done and not out.nlist and not out.transforms:
        raise ValueError(f"{description!r} describes no index")
    return out

"""Quality classifier: random-indexing word vectors, pooled, under a small network.

* Random indexing: each feature (a word's hash, and its shape: capitals, digits, signs) has a fixed
  sparse random index vector that nobody stores; a feature's vector is the sum of its neighbours'
  index vectors over every occurrence in the corpus. Features are hashed to ROWS rows, so the table
  has one size for every corpus. Each task sums its own table, and the tables are added up by row.
* Pooling: a document is the mean of its features' vectors, each weighed down by how common its
  row is, and the mean of the features' own index vectors.
* Network: two layers in numpy, trained on at most TRAINING labelled documents of the training
  folds (a documented bound); every other step sees all documents. A tenth of those documents is
  kept from training to fit a temperature, by which the network's logit is divided, so that the
  scores are calibrated probabilities.

Labels, languages, sources and ids are no inputs of a score. Training and scoring have fixed seeds
and orders: reruns agree.

Defined results: null and empty texts are scored (their pooled vector is zero); texts of any length
are pooled whole; without any training label every score is 0.5; of several labels of an id the
least counts, and of several texts of a labelled id the one with the least pooled vector is trained
on; repeated rows get equal scores; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, small_batches
from tessera.llm.textbytes import mix, parts, word_bounds, word_hashes

ROWS = 1 << 14
DIMENSIONS = 32
NONZERO = 2
OFFSETS = (1, 2)
HIDDEN = 32
TRAINING = 20_000
EPOCHS = 200
SEED = 17

_SHAPE_OF = np.zeros(256, dtype=np.uint8)  # 0: lower-case and everything beyond ASCII
_SHAPE_OF[65:91] = 1
_SHAPE_OF[48:58] = 2
_SHAPE_OF[[ord(c) for c in ".,;:?'\"()-"]] = 3
_SHAPE_OF[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, shape rows, each text's first word) of the texts' words."""
    starts, ends, first = word_bounds(data, offsets)
    rows = (word_hashes(data, starts, ends, lower=True) >> np.uint64(50)).astype(np.int64)
    kinds = _SHAPE_OF[data]
    shape = np.zeros(len(starts), dtype=np.int64)
    for kind in range(1, 5):
        sums = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int32)])
        share = (sums[ends] - sums[starts]) * 3 + (ends - starts) - 1
        # none, some, most of the word
        shape = shape * 3 + np.minimum(share // np.maximum(ends - starts, 1), 2)
    shape = shape * 3 + np.minimum((ends - starts) // 12, 2)
    shapes = (mix(shape.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(50)).astype(np.int64)
    return rows, shapes, first


def _index_vectors() -> np.ndarray:
    """(ROWS, NONZERO) signed dimensions, 1-based: each row's index vector."""
    draw = np.random.Generator(np.random.PCG64(SEED))
    return draw.integers(1, DIMENSIONS + 1, (ROWS, NONZERO)) * draw.choice([-1, 1], (ROWS, NONZERO))


_INDEX = _index_vectors()
_DENSE = np.zeros((ROWS, DIMENSIONS), dtype=np.float32)
for _j in range(NONZERO):
    np.add.at(_DENSE, (np.arange(ROWS), np.abs(_INDEX[:, _j]) - 1), np.sign(_INDEX[:, _j]).astype(np.float32))


def _accumulate(table: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    rows, shapes, first = features(data, offsets)
    counts += np.bincount(rows, minlength=ROWS) + np.bincount(shapes, minlength=ROWS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))

    def add(centre: np.ndarray, beside: np.ndarray) -> None:
        for j in range(NONZERO):
            at = _INDEX[beside, j]
            cell = centre * DIMENSIONS + np.abs(at) - 1
            table.ravel()[:] += np.bincount(cell, weights=np.sign(at), minlength=table.size)

    for offset in OFFSETS:
        near = np.flatnonzero(text[offset:] == text[:-offset]) if len(text) > offset else np.zeros(0, np.int64)
        add(np.concatenate([rows[near], rows[near + offset]]), np.concatenate([rows[near + offset], rows[near]]))
    # a word and the shapes beside it, and a shape and its word
    near = np.flatnonzero(text[1:] == text[:-1]) if len(text) > 1 else np.zeros(0, np.int64)
    add(np.concatenate([shapes, shapes[near]]), np.concatenate([rows, shapes[near + 1]]))


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The corpus's vectors (ROWS, DIMENSIONS), each of length 1, and how often each row occurs.

    Tasks emit their non-empty rows; adding them up is a partial and a final aggregate of ROWS
    groups. The driver gets ROWS rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = np.zeros((ROWS, DIMENSIONS)), np.zeros(ROWS, dtype=np.int64)
        for _, data, offsets in parts(batches, "text", 8 << 20):
            _accumulate(table, counts, data, offsets)
        rows = np.flatnonzero(counts)
        columns = [pa.array(rows), pa.array(counts[rows]), *(pa.array(table[rows, d].astype(np.int64)) for d in range(DIMENSIONS))]
        if len(rows):
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", *(f"d{d}" for d in range(DIMENSIONS))])

    schema = "row long, n long, " + ", ".join(f"d{d} long" for d in range(DIMENSIONS))
    summed = docs.select("text").mapInArrow(run, schema).groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMENSIONS)])
    found = summed.toPandas()
    table, counts = np.zeros((ROWS, DIMENSIONS)), np.zeros(ROWS)
    if len(found):
        at = found["row"].to_numpy(dtype=np.int64)
        table[at] = found[[f"d{d}" for d in range(DIMENSIONS)]].to_numpy(dtype=float)
        counts[at] = found["n"].to_numpy(dtype=float)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norms, 1e-9)).astype(np.float32), counts


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One vector a text: the weighed means of its words' vectors, and of its shapes' index vectors."""
    rows, shapes, first = features(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, 4 * DIMENSIONS), dtype=np.float32)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    at = first[some]
    for j, (of, source) in enumerate(((rows, vectors), (rows, _DENSE), (shapes, vectors), (shapes, _DENSE))):
        w = weights[of] if j < 2 else np.ones(len(of), np.float32)
        total = np.maximum(np.add.reduceat(w, at), 1e-9)
        block = slice(j * DIMENSIONS, (j + 1) * DIMENSIONS)
        for d in range(DIMENSIONS):
            out[some, block.start + d] = np.add.reduceat(source[of, d] * w, at) / total
    return out


class Network:
    """tanh hidden layer, logistic output, temperature. Inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        draw = np.random.Generator(np.random.PCG64(SEED))
        order = draw.permutation(len(x))
        held = max(1, len(x) // 10)
        calibrate, train = order[:held], order[held:] if len(x) > 1 else order
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        z = self._standard(x)
        size = x.shape[1]
        self.w1, self.b1 = draw.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = draw.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
        self.temperature = 1.0
        state = [np.zeros_like(p) for p in self._params()], [np.zeros_like(p) for p in self._params()]
        step = 0
        for _ in range(EPOCHS if len(train) < 5000 else max(20, EPOCHS * 5000 // len(train))):
            for part in np.array_split(draw.permutation(train), max(1, len(train) // 256)):
                step += 1
                self._descend(z[part], y[part], state, step)
        logits = self._logits(z[calibrate])
        losses = [(np.logaddexp(0, -logits * (2 * y[calibrate] - 1) / t).mean(), t) for t in np.geomspace(0.25, 8, 61)]
        self.temperature = min(losses)[1]

    def _params(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, np.array(self.b2)]

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _descend(self, z: np.ndarray, y: np.ndarray, state: tuple, step: int) -> None:
        hidden = np.tanh(z @ self.w1 + self.b1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30))) - y) / len(y)
        back = np.outer(error, self.w2) * (1 - hidden**2)
        slopes = [z.T @ back + 1e-4 * self.w1, back.sum(axis=0), hidden.T @ error + 1e-4 * self.w2, np.array(error.sum())]
        new = []
        for value, slope, one, two in zip(self._params(), slopes, *state, strict=True):
            one *= 0.9
            one += 0.1 * slope
            two *= 0.999
            two += 0.001 * slope**2
            new.append(value - 0.003 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8))
        self.w1, self.b1, self.w2, self.b2 = new[0], new[1], new[2], float(new[3])

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self._logits(self._standard(x)) / self.temperature, -30, 30)))


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Labels of rows whose fold is 0 are never read. Those of a null id, and null labels, don't count.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    vectors, counts = word_vectors(narrow)
    weights = (1e-3 / (1e-3 + counts / max(counts.sum(), 1))).astype(np.float32)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(fold(F.col("doc_id")) != 0).dropna()
    # the bound on what is trained on: the first TRAINING ids in the order of a hash
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING)
    known = materialise(known)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in parts(batches, "text", 1 << 20):
            x = pooled(data, offsets, *shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    trained_on = narrow.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")  # TRAINING rows at most
    pooled_rows = trained_on.mapInArrow(pool, "doc_id long, label int, x binary")
    sample = pooled_rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    network = None
    if len(sample):
        x = np.stack([np.frombuffer(b, dtype=np.float32) for b in sample["x"]]).astype(float)
        network = Network(x, sample["label"].to_numpy(dtype=float))
    fitted = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in parts(batches, "text", 1 << 20):
            x = pooled(data, offsets, *shared.value).astype(float)
            found = fitted.value.score(x) if fitted.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = narrow.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
